"""Quality rules from what a public tokenizer makes of a text.

Every whole text is measured once: its base counts, and with a public vocabulary the characters per token, the
share of byte-fallback tokens and the entropy of its tokens. The limits of a language are a band around its
median, as wide as `WIDTH` robust standard deviations of all its documents; texts without a language are judged
by their most frequent script. Short texts have wider bands. A text fails outside the band of its group, or by
the base rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable, sized

#: Width of a band in robust standard deviations, and the least spread that each measure is given.
WIDTH = {"chars_per_token": 4.0, "byte_share": 4.0, "entropy_gap": 3.0}
LEAST_SPREAD = {"chars_per_token": 0.03, "byte_share": 0.004, "entropy_gap": 0.06}
#: Rates of shorter texts scatter more: they make no band, and theirs is wider by `SHORT` and the root of what they lack.
LEAST_TOKENS = 50
SHORT = 2.0
WORDS_PER_WINDOW = 5
CACHED_WORDS = 300_000

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(ids: np.ndarray, window: int = WORDS_PER_WINDOW) -> int:
    """Words inside windows of words that are found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    codes = ids
    for k in range(1, window):  # windows of k + 1 words, numbered anew so that numbers stay small
        pairs = codes[:n + window - 1 - k].astype(np.int64) * (int(ids.max()) + 1) + ids[k:]
        codes = np.unique(pairs, return_inverse=True)[1] if k < window - 1 else pairs
    _, inverse, count = np.unique(codes, return_inverse=True, return_counts=True)
    step = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(count[inverse] > 1)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """First word of the Unicode name of most letters, such as latin; empty without letters."""
    letters = [c for c in set(text) if c.isalpha()]
    names = [unicodedata.name(c, "").split(" ")[0].lower() for c in letters]
    return max(sorted(set(names)), key=lambda s: sum(text.count(c) for c, m in zip(letters, names, strict=True) if m == s),
               default="")


class Vocabulary:
    """Token ids of words by a public vocabulary; words that were met are looked up."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())], bool)
        self.word_no: dict[str, int] = {}
        self.pieces: list[np.ndarray] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        found = list(map(self.word_no.get, words))
        if None in found:
            for k, w in enumerate(words):
                if found[k] is None:
                    no = self.word_no.get(w)
                    if no is None:
                        no = self.word_no[w] = len(self.pieces)
                        self.pieces.append(np.array(self.model.encode(w), np.int64))
                    found[k] = no
        return np.array(found, np.int64)

    def measures(self, words: list[str], word_chars: int) -> tuple[np.ndarray, tuple[int, float | None, float | None, float | None]]:
        """Word numbers, and of the tokens: their number, characters per token, byte share, entropy in bits."""
        if len(self.pieces) > CACHED_WORDS:
            self.word_no.clear()
            self.pieces.clear()
        numbers = self.numbers(words)
        if not words:
            return numbers, (0, None, None, None)
        types, of, times = np.unique(numbers, return_inverse=True, return_counts=True)
        parts = [self.pieces[k] for k in types]
        ids = np.concatenate(parts)
        weight = np.repeat(times, [len(p) for p in parts])
        n = int(weight.sum())
        if not n:
            return of, (0, None, None, None)
        counts = np.bincount(ids, weight)
        share = counts[counts > 0] / n
        return of, (n, word_chars / n, float(weight[self.byte[ids]].sum() / n), float(-(share * np.log2(share)).sum()))


MEASURED = ("doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double")


def _measured(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        names = [c.split(" ")[0] for c in MEASURED.split(", ")]
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                words = _WORD.findall(text)
                chars = sum(map(len, words))
                ids, (n, *rates) = vocabulary.measures(words, chars)
                rows.append(("lang:" + lang if lang else "script:" + script(text), len(words), chars,
                             len(_SYMBOLS.findall(text)), duplicate_lines(text), repeated_words(ids), n, *rates))
            kinds = [pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)
    return run


def measured(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Counts and token measures of every row of (doc_id, text, lang); a null text has none, null rates."""
    rows = docs.select("doc_id", "text", "lang").mapInArrow(_measured(vocabulary_path), MEASURED)
    # The most bits that so many tokens could have, less those they have: does not grow with the text alone.
    return rows.withColumn("entropy_gap", F.log2(F.greatest(F.least("n_tokens", F.lit(32_000)), F.lit(1))) - F.col("entropy"))


def bands(rows: DataFrame) -> DataFrame:
    """Per group: middle and half width of each measure, over its texts of `LEAST_TOKENS` or more tokens.

    A group without such a text is measured over all its texts.
    """
    quartiles = []
    for c in LEAST_SPREAD:
        of_long, of_all = (F.percentile_approx(x, [0.25, 0.5, 0.75]) for x in (F.when(F.col("n_tokens") >= LEAST_TOKENS, F.col(c)), F.col(c)))
        quartiles.append(F.coalesce(of_long, of_all).alias(c))
    found = rows.where(F.col("n_tokens") > 0).groupBy("band").agg(*quartiles)
    limits = []
    for c, least in LEAST_SPREAD.items():
        spread = F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(least))
        limits += [F.col(c)[1].alias(f"{c}_middle"), (spread * WIDTH[c]).alias(f"{c}_width")]
    return found.select(F.col("band").alias("_band"), *limits)


def quality(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Every row with its counts, measures, `base_failed` and `kept`.

    Null and empty texts have no words and fail the base rules. Repeated rows agree; a language of any share of
    the rows is one row of the bands, which join by broadcast below a size bound. Other columns are left out; an
    empty table gives an empty one.
    """
    rows = durable(measured(docs, vocabulary_path))
    limits = sized(bands(rows), 200)
    joined = rows.join(limits, rows["band"] == limits["_band"], "left")
    n = F.col("n_tokens")
    wider = F.when(n >= LEAST_TOKENS, F.lit(1.0)).otherwise(SHORT * F.sqrt(LEAST_TOKENS / F.greatest(n, F.lit(1))))
    outside = F.lit(False)
    for c in LEAST_SPREAD:
        off = F.col(c) - F.col(f"{c}_middle")
        # Few tokens hardly repeat, so a low gap says nothing against a short text.
        off = F.when(n >= LEAST_TOKENS, F.abs(off)).otherwise(off) if c == "entropy_gap" else F.abs(off)
        outside = outside | (off > F.col(f"{c}_width") * wider)
    out_of_band = F.coalesce(outside, F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(
        *rows.columns, failed.alias("base_failed"), (~failed & ~out_of_band).alias("kept"))
