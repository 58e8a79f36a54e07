"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole candidate spans.

The base patterns come first and their spans stay. The field segments the stretches of a text that hold digits
or an at sign: a segment is one token outside, or a span of up to `LONGEST` tokens of one kind, scored by
features of the span as a whole (its shape, digits, checksum, parts, surroundings) and by the kinds next to each
other. It learns from the base spans of a bounded sample, by its exact gradient, and dynamic programming over
entities of bounded length chooses boundaries and kinds together, so it also finds entities that a pattern
loses, such as a phone number that a greedy match joins to the card number behind it. A span that overlaps a
base span is not added.

Digits that no pattern took are learned as outside, so that the field meets numbers that are no cards. Left out
are only stretches with a candidate that would be an entity by itself and lies in a longer match that failed:
these joined entities are what the field is to find.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Bounds of the training sample, which holds whole texts up to a length, and of an entity in tokens.
SAMPLE_TEXTS = 600
SAMPLE_CHARS = 20_000
SAMPLE_STRETCHES = 500
LONGEST = 16
STEPS = 25
#: An added span needs this much more weight than leaving its tokens outside.
MARGIN = 2.0

_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARD = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CARD_SHAPE = re.compile(r"[0-9]+([\x20-][0-9]+)*")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_entity(span: str) -> bool:
    """Whether the span as a whole has the form of one of the numbered kinds."""
    digits = len(_NOT_DIGIT.sub("", span))
    if _CARD_SHAPE.fullmatch(span):
        return 14 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", span))
    if _PHONE.fullmatch(span):
        return 10 <= digits <= 15
    return bool(_IP.fullmatch(span)) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in span.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind. Linear in the text."""
    out: list[Span] = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            first = at
            while first > done and _LOCAL_BACKWARD.match(text, first - 1, first):
                first -= 1
            found = _EMAIL_DOMAIN.match(text, at) if first < at else None
            if found:
                out.append((first, 0, found.end()))
                done = found.end()
            at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Stretch:
    """Tokens of a part of a text, and its candidate spans (first token, last token + 1, features)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], features) -> None:
        self.tokens = tokens
        self.candidates: list[tuple[int, int, object]] = []
        for i, (start, _) in enumerate(tokens):
            gap = letters = False
            digits = dots = at = 0
            if text[start] in ".-)":
                continue
            for j in range(i, min(i + LONGEST, len(tokens))):
                a, b = tokens[j]
                if j > i and a != tokens[j - 1][1]:
                    if a != tokens[j - 1][1] + 1 or text[a - 1] != " ":
                        break
                    gap = True
                c = text[a]
                if "0" <= c <= "9":
                    digits += b - a
                elif c.isalpha():
                    letters = True
                dots += c == "."
                at += c == "@"
                if gap and (letters or at) or at > 1:
                    break
                if (at and letters and dots or digits >= 7 and not letters or digits >= 4 and dots == 3 and not letters) \
                        and c not in ".-(@+":
                    self.candidates.append((i, j + 1, features(text, start, b)))


def stretches(text: str, features) -> list[Stretch]:
    """Parts of a text that can hold an entity, each as far as its candidates reach."""
    out: list[Stretch] = []
    tokens: list[tuple[int, int]] = []
    last = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < last:
            continue
        # From the trigger to both sides: at most LONGEST tokens, and no further than a line break.
        first = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 20 * LONGEST, last, 0)
        while first > last and first > 0 and not text[first - 1].isspace() and not text[first].isspace() \
                and m.start() - first < 40 * LONGEST:
            first -= 1
        stop = m.start()
        while True:  # further triggers nearby belong to the same stretch
            following = _TRIGGER.search(text, stop + 1, min(len(text), stop + 120))
            if following is None:
                break
            stop = following.start()
        end = min(len(text), stop + 120)
        tokens = [t.span() for t in _TOKEN.finditer(text, max(first, 0), end)]
        last = end
        found = Stretch(text, tokens, features)
        if found.candidates:
            out.append(found)
    return out


def _around(c: str) -> str:
    return "" if not c else "_" if c.isspace() else "0" if c.isdigit() else "a" if c.isalpha() else c


def span_features(text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of a whole span; equal tuples have equal weights."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "d" if len(m.group()) > 6 else "d" * len(m.group()), span))
    if "@" in span:
        local, _, domain = span.partition("@")
        shape = ("a" if re.fullmatch(r"[A-Za-z0-9._%+-]+", local) else "?") + "@" + (
            "a" if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain) else "?")
    digits = _NOT_DIGIT.sub("", span)
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    before, after = text[start - 1:start] if start else "", text[end:end + 1]
    follows = after in "-." and text[end + 1:end + 2].isdigit() if after else False
    return ("bias", "s:" + shape[:40], f"n:{len(digits) if '@' not in span else 'x'}",
            "c:" + "".join(sorted(set(re.sub(r"[\w\s]", "", span)))), f"g:{min(span.count(' '), 5)}",
            f"f:{_around(span[0])}", f"l:{len(digits) >= 13 and luhn(digits)}", f"o:{octets}", f"e:{is_entity(span)}",
            f"b:{_around(before)}", f"a:{_around(after)}{follows}")


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights of features and kinds, and of a kind after a kind; None finds nothing."""

    def __init__(self, numbers: dict[str, int] | None, weights: np.ndarray | None, follow: np.ndarray | None) -> None:
        self.numbers, self.weights, self.follow = numbers, weights, follow
        self.known: dict[tuple, list[float]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def kinds(self, features: tuple[str, ...]) -> list[float]:
        found = self.known.get(features)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            rows = [self.numbers[f] for f in features if f in self.numbers]
            found = self.known[features] = self.weights[rows].sum(0).tolist()
        return found

    def best(self, stretch: Stretch) -> list[tuple[int, int, int]]:
        """Viterbi over segments: (first token, end token, kind) of the chosen spans."""
        n, follow = len(stretch.tokens), self.follow.tolist()
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, features in stretch.candidates:
            ending[j].append((i, self.kinds(features)))
        none = -math.inf
        score = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]
        score[0][OUTSIDE] = 0.0
        back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(n + 1)]
        for j in range(1, n + 1):
            for p in range(OUTSIDE + 1):  # one token outside
                s = score[j - 1][p] + follow[p][OUTSIDE]
                if s > score[j][OUTSIDE]:
                    score[j][OUTSIDE], back[j][OUTSIDE] = s, (j - 1, p)
            for i, weights in ending[j]:
                for k in range(OUTSIDE):
                    for p in range(OUTSIDE + 1):
                        s = score[i][p] + follow[p][k] + weights[k] - MARGIN
                        if s > score[j][k]:
                            score[j][k], back[j][k] = s, (i, p)
        out, j, k = [], n, max(range(OUTSIDE + 1), key=lambda k: score[n][k])
        while j:
            i, p = back[j][k]
            if k != OUTSIDE:
                out.append((i, j, k))
            j, k = i, p
        return out[::-1]


def _gradient(stretch: tuple, weights: np.ndarray, follow: np.ndarray, g_w: np.ndarray, g_f: np.ndarray) -> None:
    """Adds expected less gold counts of one stretch: (tokens, candidates as (i, j, feature rows), gold)."""
    n, candidates, gold = stretch
    f = follow.tolist()
    spans = [(i, j, rows, weights[rows].sum(0).tolist()) for i, j, rows in candidates]
    steps: list[list] = [[] for _ in range(n + 1)]
    for c, (i, j, _, w) in enumerate(spans):
        steps[j].extend((i, k, w[k], c) for k in range(OUTSIDE))
    for j in range(1, n + 1):
        steps[j].append((j - 1, OUTSIDE, 0.0, -1))
    none, kinds = -1e30, range(OUTSIDE + 1)
    fwd = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]
    fwd[0][OUTSIDE] = 0.0
    for j in range(1, n + 1):
        into: list[list[float]] = [[] for _ in kinds]
        for i, k, w, _ in steps[j]:
            into[k].append(w + _log_sum([fwd[i][p] + f[p][k] for p in kinds]))
        for k in kinds:
            if into[k]:
                fwd[j][k] = _log_sum(into[k])
    total = _log_sum(fwd[n])
    bwd = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]
    bwd[n] = [0.0] * (OUTSIDE + 1)
    for j in range(n, 0, -1):
        for i, k, w, c in steps[j]:
            beyond = w + bwd[j][k]
            mass = 0.0
            for p in kinds:
                here = f[p][k] + beyond
                high, low = max(bwd[i][p], here), min(bwd[i][p], here)
                bwd[i][p] = high + math.log1p(math.exp(low - high))
                m = fwd[i][p] + here - total
                if m > -40:
                    m = math.exp(m)
                    g_f[p, k] += m
                    mass += m
            if c >= 0 and mass:
                np.add.at(g_w, (spans[c][2], k), mass)
    at, before = 0, OUTSIDE
    for c, k in gold:
        i, j, rows, _ = spans[c]
        for _ in range(at, i):
            g_f[before, OUTSIDE] -= 1
            before = OUTSIDE
        g_f[before, k] -= 1
        np.subtract.at(g_w, (rows, k), 1.0)
        at, before = j, k
    for _ in range(at, n):
        g_f[before, OUTSIDE] -= 1
        before = OUTSIDE


def fit(texts: list[str]) -> Field:
    """A field that learns the base spans of texts; without any it finds nothing."""
    numbers: dict[str, int] = {}
    found, some = [], 0
    for text in texts:
        spans = base_spans(text)
        for stretch in stretches(text, span_features):
            lo, hi = stretch.tokens[0][0], stretch.tokens[-1][1]
            place = {(stretch.tokens[i][0], stretch.tokens[j - 1][1]): c for c, (i, j, _) in enumerate(stretch.candidates)}
            inside = [s for s in spans if lo <= s[0] < hi]
            gold, end, whole = [], -1, True
            for start, kind, stop in inside:
                if (start, stop) not in place:
                    whole = False
                elif start >= end:
                    gold.append((place[start, stop], kind))
                    end = stop
            # A candidate that is an entity by itself, and that a pattern lost, may be one: nothing is learned there.
            taken = [(s[0], s[2]) for s in inside]
            lost = any(is_entity(text[stretch.tokens[i][0]:stretch.tokens[j - 1][1]]) and not any(
                a < stretch.tokens[j - 1][1] and stretch.tokens[i][0] < b for a, b in taken)
                for i, j, _ in stretch.candidates)
            if whole and not lost:
                some += len(gold)
                candidates = [(i, j, [numbers.setdefault(f, len(numbers)) for f in fs]) for i, j, fs in stretch.candidates]
                found.append((len(stretch.tokens), candidates, gold))
    found = found[:SAMPLE_STRETCHES]
    if not some:
        return Field(None, None, None)
    w, f = np.zeros((len(numbers), OUTSIDE)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    sq_w, sq_f = np.full_like(w, 1e-8), np.full_like(f, 1e-8)
    for _ in range(STEPS):
        g_w, g_f = np.zeros_like(w), np.zeros_like(f)
        for stretch in found:
            _gradient(stretch, w, f, g_w, g_f)
        g_w, g_f = g_w / len(found) + 1e-3 * w, g_f / len(found) + 1e-3 * f
        sq_w, sq_f = sq_w + g_w * g_w, sq_f + g_f * g_f
        w, f = w - 0.5 * g_w / np.sqrt(sq_w), f - 0.5 * g_f / np.sqrt(sq_f)
    return Field(numbers, w, f)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans; base and added spans together."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    if field.numbers is not None:
        for stretch in stretches(text, span_features):
            for i, j, kind in field.best(stretch):
                start, end = stretch.tokens[i][0], stretch.tokens[j - 1][1]
                if all(end <= s[0] or s[2] <= start for s in base):
                    added.append((start, kind, end))
    return base, sorted({*base, *added})


def _found(field: Field):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(t or "", field) for t in batch.column(1).to_pylist()]
            parts = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r[part]] for r in rows], kind)
                     for part in (0, 1)]
            yield pa.record_batch([batch.column(0), *parts], ["doc_id", "base", "spans"])
    return run


def train(docs: DataFrame) -> Field:
    """Fit to at most `SAMPLE_TEXTS` different whole texts with digits or an at sign, those with the least hashes.

    Texts of more than `SAMPLE_CHARS` characters are not learned from, which bounds what the driver holds.
    The hashes are chosen first, so that no text but the chosen ones leaves the executors.
    """
    some = docs.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9]{7}|@|[0-9] ?[-.(] ?[0-9]{3}")).select(
        F.xxhash64("text").alias("key"), "text")
    keys = some.select("key").distinct().orderBy("key").limit(SAMPLE_TEXTS).collect()
    if not keys:
        return fit([])
    rows = some.where(F.col("key") <= keys[-1]["key"]).groupBy("key").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows)])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive) of every whole text.

    Null and empty texts have none. Rows are read one by one: repeated rows agree and nothing is shuffled. Other
    columns are left out; an empty table gives an empty one.
    """
    schema = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(_found(train(docs)), f"doc_id long, base {schema}, spans {schema}")
