"""Token ids of whole texts by a public byte-level tokenizer, with a cache of text pieces.

The tokenizer cuts a text before every single space that stands between two printing characters, so such pieces
are encoded on their own and looked up afterwards. Only pieces that a worker has not met go to the tokenizer.

Texts of Latin letters, digits, ASCII marks and plain white space are cut further, in numpy, wherever the tokenizer cuts
them: a word is met more often by itself than with the marks and line breaks around it. Equal pieces are looked up once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

CACHED_PIECES = 150_000
PIECES_AT_ONCE = 20_000
#: Plain pieces sent to the tokenizer as the lines of one text; longer texts take it more time a line.
LINES_AT_ONCE = 500
#: Bytes of plain texts that are cut together.
BYTES_AT_ONCE = 1 << 22

#: Letters and marks on which all versions of Unicode agree; beyond ASCII there are letters alone.
_PLAIN = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f!-~ \\t\\n\\r]*")
_ADDED = "<|endoftext|>"
_END, _LETTER, _DIGIT, _MARK, _BLANK = range(5)
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[:128] = [_LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _BLANK if chr(i) in " \t\n\r" else _MARK
               for i in range(128)]
_KIND[0] = _END


def _printing(c: str) -> bool:
    return "!" <= c <= "~" or c > "\x7f" and c.isalnum()


class _Store:
    """Numbered pieces with their ids; what is new in a batch is encoded at its end."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)
        self.new: list[str] = []

    def of(self, key: str) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.sizes) + len(self.new)
            self.new.append(key)
        return found

    def add(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])

    def settle(self, most: int) -> bool:
        """Forget the pieces beyond the bound, the last that were met; the frequent ones come early."""
        before, full = len(self.sizes) - len(self.new), len(self.sizes) > most
        if full:
            kept = max(before, most)
            for key in self.new[kept - before:]:
                del self.number[key]
            self.ids, self.sizes = self.ids[:self.sizes[:kept].sum()], self.sizes[:kept]
        self.new = []
        return full


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and _ADDED not in text


def cuts(data: np.ndarray) -> np.ndarray:
    """Where the tokenizer cuts plain texts in UTF-8, each with a zero byte behind it, which is a piece by itself.

    It takes runs of one kind, with a space in front if there is one; the last white space before another kind stands
    alone, and so do 's, 't, 'm, 'd, 're, 've and 'll where no space is in front.
    """
    kind = _KIND[data]
    starts = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _END)
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & (kind[1:] != _END))
    starts[last] = True
    starts[last[data[last] == ord(" ")] + 1] = False
    short = np.flatnonzero(data[:-1] == ord("'"))
    short = short[starts[short] & (kind[short + 1] == _LETTER)]
    a, b = data[short + 1], data[short + 2]  # a letter is never the last byte
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    one = np.isin(a, list(b"stmd"))
    short, size = short[one | two], np.where(one, 2, 3)[one | two]
    starts[short + 1] = False
    starts[short + size] = True
    return np.flatnonzero(starts)


def _gathered(at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of the pieces with the given numbers, from those of all pieces."""
    offsets, lengths = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(lengths)
    return ids[np.repeat(offsets[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Encodes lists of texts into flat ids and a length per text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.plain = _Store()  # pieces of plain texts, as bytes
        self.spaced = _Store()  # a space and a word, which stand for themselves anywhere
        self.lined: list[str] = []
        self.other = _Store()  # beginnings of texts, and pieces with other white space

    def _plain_numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of plain texts, and how many each text has."""
        data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        starts = cuts(data)
        ends = np.flatnonzero(data[starts] == 0)
        offsets = np.append(starts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        # The zero byte needs no number.
        number = np.fromiter((-1 if p == b"\0" else self.plain.of(p) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return np.delete(number[coded.indices.to_numpy()], ends), np.diff(ends, prepend=-1) - 1

    def _encode_plain(self) -> None:
        """Encode new pieces of plain texts: white space one by one, the rest as the lines of one text.

        The tokenizer makes a token of its own of the line break behind a line.
        """
        new = [p.decode() for p in self.plain.new]
        order = sorted(range(len(new)), key=lambda k: new[k].isspace())
        lines = [new[k] for k in order if not new[k].isspace()]
        blank = [e.ids for e in self.tokenizer.encode_batch_fast([new[k] for k in order[len(lines):]], add_special_tokens=False)]
        ids, sizes = [], []
        for lo in range(0, len(lines), LINES_AT_ONCE):
            text = "\n".join(lines[lo:lo + LINES_AT_ONCE]) + "\n"
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(found == self.line_end)
            ids.append(np.delete(found, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        sizes = np.concatenate([*sizes, np.array(list(map(len, blank)), np.int64)])
        at = np.argsort(np.array(order, np.int64))  # back into the order of their numbers
        self.plain.add([_gathered(at, sizes, np.concatenate([*ids, np.array([i for e in blank for i in e], np.uint32)]))], [sizes[at]])

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain texts to flat ids and a length per text."""
        data, sizes = [t.encode() for t in texts], np.array([0, *map(len, texts)])
        part = np.cumsum(sizes)[:-1] // BYTES_AT_ONCE
        found = [self._plain_numbers(data[a:b]) for a, b in zip(*self._bounds(part), strict=True)]
        self._encode_plain()
        store = self.plain
        at, counts = (np.concatenate([np.zeros(0, np.int64), *some]) for some in (zip(*found) if found else ([], [])))
        ends = np.cumsum(np.concatenate([[0], store.sizes[at]]))[np.cumsum(np.concatenate([[0], counts]))]
        flat = _gathered(at, store.sizes, store.ids)
        store.settle(CACHED_PIECES)
        return flat, np.diff(ends)

    @staticmethod
    def _bounds(part: np.ndarray) -> tuple[list[int], list[int]]:
        first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        return first, [*first[1:], len(part)] if first else []

    def _pieces(self, text: str) -> list[int]:
        """Numbers of the pieces of a text that is not plain; those of the second store count down from -1."""
        parts = text.split(" ")
        found = list(map(self.spaced.number.get, parts))
        found[0] = -1 - self.other.of(parts[0]) if parts[0] and _printing(parts[0][-1]) else None
        if None not in found:
            return found
        if found[0] is not None:
            missing = [k for k, n in enumerate(found) if n is None]
            if all(parts[k] and _printing(parts[k][0]) and _printing(parts[k][-1]) for k in missing):
                for k in missing:
                    w = parts[k]
                    found[k] = self._lined(w) if "\n" in w else self.spaced.of(w)
                return found
        return self._slowly(parts)

    def _lined(self, word: str) -> int:
        """A word with a line break is kept in the second store, and found under its name in the first."""
        found = self.spaced.number.get(word)  # it may stand twice in one text
        if found is None:
            found = self.spaced.number[word] = -1 - self.other.of(" " + word)
            self.lined.append(word)
        return found

    def _slowly(self, parts: list[str]) -> list[int]:
        out, open_parts = [], [parts[0]]
        for part in parts[1:]:
            last = open_parts[-1]
            if last and _printing(last[-1]) and part and _printing(part[0]):
                self._flush(open_parts, out)
                open_parts = [None, part]  # None: a space stands in front
            else:
                open_parts.append(part)
        self._flush(open_parts, out)
        return out

    def _flush(self, parts: list, out: list[int]) -> None:
        if parts[0] is None and len(parts) == 2 and _printing(parts[1][-1]) and "\n" not in parts[1]:
            out.append(self.spaced.of(parts[1]))
            return
        piece = " ".join("" if p is None else p for p in parts)
        if piece:
            out.append(-1 - self.other.of(piece))

    def _encode_new(self) -> None:
        """Encode what is new: many words as the lines of one text, the rest one by one.

        The tokenizer makes a token of its own of a line break before a space, which ends a word here.
        """
        new = self.spaced.new
        ids, sizes = [], []
        for lo in range(0, len(new), PIECES_AT_ONCE):
            some = new[lo:lo + PIECES_AT_ONCE]
            text = " " + "\n ".join(some) + "\n "
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids[:-1], np.uint32)
            ends = np.flatnonzero(found == self.line_end)
            ids.append(np.delete(found, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        self.spaced.add(ids, sizes)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(self.other.new, add_special_tokens=False)]
        self.other.add([np.array([i for e in rest for i in e], np.uint32)], [np.array(list(map(len, rest)), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        is_plain = np.array([plain(t) for t in texts], bool)
        flat, sizes = self._encode_texts([t for t, p in zip(texts, is_plain, strict=True) if p])
        if is_plain.all():
            return flat, sizes
        others, of_others = self._encode_others([t for t, p in zip(texts, is_plain, strict=True) if not p])
        sizes = np.concatenate([sizes, of_others])
        at = np.argsort(np.argsort(~is_plain, kind="stable"))  # back into the order of the texts
        return _gathered(at, sizes, np.concatenate([flat, others])), sizes[at]

    def _encode_others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self._pieces(t) for t in texts]
        self._encode_new()
        a, b = self.spaced, self.other
        sizes = np.concatenate([a.sizes, b.sizes[::-1]])
        offsets = np.concatenate([np.cumsum(a.sizes) - a.sizes, (np.cumsum(b.sizes) - b.sizes + len(a.ids))[::-1]])
        ids = np.concatenate([a.ids, b.ids])
        at = np.fromiter((p for r in rows for p in r), np.int64, sum(map(len, rows)))
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        flat = ids[np.repeat(offsets[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]
        a.settle(CACHED_PIECES)
        if b.settle(CACHED_PIECES // 4):
            for word in self.lined:
                del a.number[word]
        self.lined = []
        return flat, np.diff(upto)
