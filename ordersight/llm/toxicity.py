"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give scores and offsets.

Labels mark documents, so token labels come first: in the training sample a token of a toxic document is
labelled toxic if the word, or one of its beginnings, is met in far more toxic than clean documents. The field
has two states, weights for words and word beginnings (hashed) and for transitions; it is fitted to the labelled
tokens by its exact gradient. Forward-backward marginals of every token of every whole text are reduced to the
greatest log odds, the expected number of toxic tokens and the number of tokens, and a logistic model of these gives
the score. It is fitted to the document labels of the sample, weighted to the shares that the classes have among all
labels, and on marginals of fields that have not seen the document: the sample is parted into folds for it. Tokens with a marginal of a half or more are the offending spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import held_out, label_counts, training_sample
from ordersight.llm.learn import adagrad, logistic, probability

#: Bounds of the training sample, per class.
ROWS_PER_CLASS = 1500
TOKENS_PER_ROW = 20_000
THRESHOLD = 0.3
#: Parts of the sample, each summarised by a field learned from the others.
FOLDS = 2
WEIGHTS = 1 << 16
BEGINNINGS = (4, 5)
STEPS = 25
LEAST_DOCS = 3
LEAST_LOG_ODDS = 2.5
ROWS_AT_ONCE = 1000
CACHED_WORDS = 200_000
WORD = re.compile(r"\w+")
ODDS = 12.0


def tokens(text: str | None) -> list[str]:
    text = text or ""
    low = text.lower()
    # Where lower-casing changes the length, tokens keep the places that they have in the text.
    return WORD.findall(low) if len(low) == len(text) else [x.lower() for x in WORD.findall(text)]


def units(word: str) -> list[str]:
    """A word and its beginnings, by which unseen forms are known."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def _slot(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass")) % WEIGHTS


class Chains:
    """Token sequences laid out by place in the text, longest first, so that all advance together."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        lengths = sizes[self.order]
        first = (np.cumsum(sizes) - sizes)[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        place = np.repeat(np.arange(longest), self.alive)
        rank = np.arange(self.at[-1]) - self.at[place] if longest else np.zeros(0, np.int64)
        self.token = first[rank] + place  # of the flat tokens, in the order of the layout

    def marginals(self, emission: np.ndarray, trans: np.ndarray, with_pairs: bool = False) -> tuple:
        """Log odds of state 1 per token, and where asked the summed pair marginals of the four transitions.

        `emission` is the log weight of state 1 over state 0, flat; `trans` the 2 x 2 log weights.
        """
        e = np.clip(emission, -30, 30)[self.token]
        t = np.exp(trans)
        n = len(self.alive)
        f = np.zeros(len(e))  # log of forward state 1 over state 0, emission included
        b = np.zeros(len(e))  # the same backward, emission left out
        for k in range(n):
            lo, hi = self.at[k], self.at[k + 1]
            if k:
                r = np.exp(f[self.at[k - 1]:self.at[k - 1] + hi - lo])
                f[lo:hi] = np.log((t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])) + e[lo:hi]
            else:
                f[lo:hi] = e[lo:hi]
        for k in range(n - 2, -1, -1):
            lo, nxt, m = self.at[k], self.at[k + 1], self.alive[k + 1]
            r = np.exp(b[nxt:nxt + m] + e[nxt:nxt + m])
            b[lo:lo + m] = np.log((t[1, 0] + r * t[1, 1]) / (t[0, 0] + r * t[0, 1]))
        odds = np.empty(len(e))
        odds[self.token] = f + b
        if not with_pairs:
            return odds, None
        pairs = np.zeros((2, 2))
        for k in range(n - 1):
            nxt, m = self.at[k + 1], self.alive[k + 1]
            left, right = np.exp(f[self.at[k]:self.at[k] + m]), np.exp(b[nxt:nxt + m] + e[nxt:nxt + m])
            p = np.stack([np.full(m, t[0, 0]), right * t[0, 1], left * t[1, 0], left * right * t[1, 1]])
            pairs += (p / p.sum(0)).sum(1).reshape(2, 2)
        return odds, pairs


def summary(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: greatest log odds of a token, logs of one plus the expected toxic tokens and of one plus all tokens.

    The greatest of many is higher than of few without any meaning, so the number of tokens goes along.
    """
    out = np.zeros((len(sizes), 3))
    out[:, 2] = np.log1p(sizes)
    out[:, 0] = -ODDS
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.clip(np.maximum.reduceat(odds, starts), -ODDS, ODDS)
        out[full, 1] = np.log1p(np.add.reduceat(probability(odds), starts))
    return out


class Tagger:
    """The fitted field and the document model; None weights score everything 0."""

    def __init__(self, weights: np.ndarray | None, trans: np.ndarray, document: np.ndarray) -> None:
        self.weights, self.trans, self.document = weights, trans, document
        self.table = [] if weights is None else weights.tolist()  # plain floats: quicker for a few at a time
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emissions(self, text: str | None) -> np.ndarray:
        """Log weight of state 1 over state 0 of every token; words that were met are looked up."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = tokens(text)
        found = list(map(self.known.get, words))
        if None in found:
            for k, w in enumerate(words):
                if found[k] is None:
                    found[k] = self.known.get(w)
                    if found[k] is None:
                        found[k] = self.known[w] = sum([self.table[_slot(u)] for u in units(w)], self.table[-1])
        return np.array(found, np.float64)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of documents; log odds of all tokens, flat; tokens per document."""
        if self.weights is None:
            return np.zeros(len(texts)), np.zeros(0), np.zeros(len(texts), np.int64)
        rows = [self.emissions(t) for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        odds, _ = Chains(sizes).marginals(np.concatenate([np.zeros(0), *rows]), self.trans)
        return probability(self.document[0] + summary(odds, sizes) @ self.document[1:]), odds, sizes


class Sample:
    """Labelled documents as numbers of words, and the words' units as numbers; no strings are kept twice."""

    def __init__(self, texts: list[str | None], labels: list[int]) -> None:
        words: dict[str, int] = {}
        rows = [np.fromiter((words.setdefault(w, len(words)) for w in tokens(t)[:TOKENS_PER_ROW]), np.int32) for t in texts]
        self.labels = np.array(labels)
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.word = np.concatenate(rows)
        self.vocabulary = list(words)
        number: dict[str, int] = {}
        per_word = [[number.setdefault(u, len(number)) for u in units(w)] for w in self.vocabulary]
        self.of = np.repeat(np.arange(len(per_word)), [len(u) for u in per_word])
        self.unit = np.fromiter((u for us in per_word for u in us), np.int64, len(self.of))
        self.slot = np.fromiter(map(_slot, number), np.int64, len(number))

    def gold(self) -> np.ndarray:
        """Toxic tokens of toxic documents, by document counts of their words and beginnings."""
        first = np.searchsorted(self.of, np.arange(len(self.vocabulary) + 1))
        counts = np.zeros((2, len(self.slot)), np.int64)
        for row, label in zip(np.split(self.word, np.cumsum(self.sizes)[:-1]), self.labels, strict=True):
            own = np.unique(row)
            n = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts[label, np.unique(self.unit[at])] += 1
        clean, toxic = (self.labels == 0).sum(), (self.labels == 1).sum()
        odds = np.log((counts[1] + 0.5) / (toxic + 1)) - np.log((counts[0] + 0.5) / (clean + 1))
        marked = (counts[1] >= LEAST_DOCS) & (odds >= LEAST_LOG_ODDS)
        words = np.bincount(self.of, marked[self.unit], len(self.vocabulary)) > 0
        return words[self.word] & np.repeat(self.labels == 1, self.sizes)


def _field(sample: Sample) -> np.ndarray:
    """Weights of the units, the bias in the last place, and of the four transitions behind them."""
    gold, sizes, word, words = sample.gold(), sample.sizes, sample.word, len(sample.vocabulary)
    slot, of = sample.slot[sample.unit], sample.of
    chains = Chains(sizes)
    g = gold.astype(np.int8)
    inside = np.ones(max(len(g) - 1, 0), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[ends[(ends > 0) & (ends < len(g))] - 1] = False
    gold_pairs = np.bincount((g[:-1] * 2 + g[1:])[inside], minlength=4).reshape(2, 2) if len(g) else np.zeros((2, 2))
    n = max(len(sizes), 1)

    def emissions(w: np.ndarray) -> np.ndarray:
        return np.bincount(of, w[slot], words)[word] + w[WEIGHTS - 1]

    def gradient(w: np.ndarray) -> np.ndarray:
        odds, pairs = chains.marginals(emissions(w), w[WEIGHTS:].reshape(2, 2), with_pairs=True)
        off = np.bincount(word, probability(odds) - gold, words)
        out = np.zeros(WEIGHTS + 4)
        out[:WEIGHTS] = np.bincount(slot, off[of], WEIGHTS)
        out[WEIGHTS - 1] += off.sum()
        out[WEIGHTS:] = (pairs - gold_pairs).ravel()
        return out / n + 1e-4 * w
    return adagrad(gradient, WEIGHTS + 4, STEPS)


def _summaries(w: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Summaries of documents under a field, of the tokens that a sample keeps."""
    tagger = Tagger(w[:WEIGHTS], w[WEIGHTS:].reshape(2, 2), np.zeros(4))
    rows = [tagger.emissions(t)[:TOKENS_PER_ROW] for t in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    odds, _ = Chains(sizes).marginals(np.concatenate([np.zeros(0), *rows]), tagger.trans)
    return summary(odds, sizes)


def fit(texts: list[str | None], labels: list[int], counts: dict[int, int] | None = None) -> Tagger:
    """A tagger from labelled documents; the first `TOKENS_PER_ROW` tokens of each are learned from.

    `counts` are documents per class where the texts were drawn from; without them the texts' own numbers hold.
    """
    if len(set(labels)) < 2:
        return Tagger(None, np.zeros((2, 2)), np.zeros(4))
    y = np.array(labels)
    w = _field(Sample(texts, labels))
    # Folds go through each class in turn; a class of one document is in a single fold.
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    x = np.zeros((len(y), 3))
    for k in range(FOLDS):
        seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(unseen):
            own = _field(Sample([texts[i] for i in seen], y[seen].tolist())) if len(set(y[seen])) == 2 else w
            x[unseen] = _summaries(own, [texts[i] for i in unseen])
    sampled = np.bincount(y, minlength=2)
    shares = np.array([(counts or {}).get(c, 0) or sampled[c] for c in (0, 1)], float)
    weight = shares / shares.sum() * len(y) / sampled
    document = logistic(x, y.astype(float), weight[y], ridge=0.1)
    return Tagger(w[:WEIGHTS], w[WEIGHTS:].reshape(2, 2), document)


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    """Character ranges of the tokens with a marginal of a half or more."""
    low = text.lower()
    places = [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]
    return [{"start": places[i][0], "end": places[i][1]} for i in np.flatnonzero(odds >= 0) if i < len(places)]


def _scored(tagger: Tagger, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):  # few texts are held as strings at a time
                batch = whole.slice(lo, ROWS_AT_ONCE)
                texts = batch.column(1).to_pylist()
                score, odds, sizes = tagger.score(texts)
                parts = np.split(odds, np.cumsum(sizes)[:-1])
                spans = [_spans(t or "", o) if len(o) and o.max() >= 0 else [] for t, o in zip(texts, parts, strict=True)]
                yield pa.record_batch([
                    *batch.columns[:1 + back], pa.array(score),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [*batch.schema.names[:1 + back], "score", "spans"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Tagger:
    """Fit to at most `rows_per_class` labelled documents of each class, none of them held out."""
    rows = training_sample(docs, labels, "toxic", rows_per_class, ["text"])
    return fit([r["text"] for r in rows], [r["label"] for r in rows], label_counts(labels, "toxic"))


def scored(docs: DataFrame, tagger: Tagger, columns: list[str]) -> DataFrame:
    """The named columns of every row with `score`, `predicted` and `spans` (character ranges), texts read whole.

    Null and empty texts have no tokens and the lowest score. Rows are scored one by one: repeated rows agree,
    and nothing is shuffled. An empty table gives an empty one; without labels of both classes all scores are 0.
    """
    sent = [c for c in columns if c != "text"]
    rows = docs.select(F.struct(*sent).alias("key") if sent else F.struct(F.lit(0)).alias("key"), "text")
    back = "text" in columns  # the text travels once each way, and back only where it is asked for
    schema = T.StructType([*rows.schema.fields[:1 + back], T.StructField("score", T.DoubleType()), T.StructField(
        "spans", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end")])))])
    out = rows.mapInArrow(_scored(tagger, back), schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"key.`{c}`") for c in columns), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    return scored(docs, train(docs, labels), ["doc_id"]).withColumn("held_out", held_out())
