"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed words (as shares of a text's words) and what words look like: symbols, repeated
neighbours, variety, length. The metadata view sees the page around them: source, language, number of lines,
line lengths, total length. Each view is a logistic model on a bounded sample of labelled documents. Over
`ROUNDS` rounds each view scores all unlabelled documents in a Spark job, takes the `HANDED_OVER` of each class that
it is surest of, and hands them to the other view. Sureness is calibrated on labelled rows that the views do not see, so a
view that knows nothing hands nothing over, however far its own scores lie apart. At the end both views are calibrated on a part of the labelled rows
that neither was fitted to, and a logistic model of the two calibrated log odds scores every whole document.

Both views of all documents are computed once and written, so that a round reads numbers and no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import durable, held_out, sized, training_sample
from ordersight.llm.learn import logistic, probability

#: Bounds of what is fitted: labelled rows per class, and rows that a view hands over per round and class.
ROWS_PER_CLASS = 1500
ROUNDS = 4
HANDED_OVER = 60
#: Only rows whose calibrated log odds are at least so far from even are handed over (4 to 1).
SURE = 1.4
#: Nothing is handed over where fewer labelled rows of a class are left for the calibration.
LEAST_CALIBRATION = 8
THRESHOLD = 0.5
BUCKETS = 256
CATEGORIES = 64
LOG_ODDS = 8.0
CACHED_WORDS = 300_000


def _hash(value: str, into: int) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) % into


class Words:
    """Hash bucket and share of symbols of a word, looked up after its first meeting."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[int, float, int, int]] = []

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHED_WORDS:
            self.number.clear()
            self.rows.clear()
        out = []
        for w in words:
            no = self.number.get(w)
            if no is None:
                no = self.number[w] = len(self.rows)
                odd = sum(not c.isalnum() for c in w)
                self.rows.append((_hash(w.lower(), BUCKETS), odd / len(w), odd >= 3 or odd == len(w), len(w)))
            out.append(no)
        return np.array(out, np.int64)


def text_view(text: str | None, words: Words) -> np.ndarray:
    parts = (text or "").split()
    x = np.zeros(BUCKETS + 6)
    if not parts:
        return x
    no = words.of(parts)
    table = np.array([words.rows[k] for k in np.unique(no)], np.float64)
    times = np.bincount(np.unique(no, return_inverse=True)[1])
    n = len(parts)
    np.add.at(x, table[:, 0].astype(np.int64), times / n)
    x[:BUCKETS] = np.sqrt(x[:BUCKETS])
    x[BUCKETS:] = [(table[:, 1] * times).sum() / n * 5, (table[:, 2] * times).sum() / n * 5,
                   (no[1:] == no[:-1]).mean() * 5 if n > 1 else 0.0, len(times) / n, (table[:, 3] * times).sum() / n / 5,
                   np.log1p(times.max() / n)]
    return x


def metadata_view(text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    x = np.zeros(2 * CATEGORIES + 5)
    x[_hash("s:" + source if source is not None else "no source", CATEGORIES)] = 1
    x[CATEGORIES + _hash("l:" + lang if lang is not None else "no language", CATEGORIES)] = 1
    lines = [len(s) for s in (text or "").split("\n")]
    x[2 * CATEGORIES:] = [np.log1p(len(text or "")) / 5, np.log1p(len(lines)), np.log1p(max(lines)) / 5,
                          np.log1p(min(lines)) / 5, np.log1p(float(np.mean(lines))) / 5]
    return x


def raw_odds(view: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(view[0] + x @ view[1:], -LOG_ODDS, LOG_ODDS)


def calibrated(view: np.ndarray, calibration: np.ndarray, x: np.ndarray) -> np.ndarray:
    return calibration[0] + calibration[1] * raw_odds(view, x)


class Model:
    """Two views, their calibrations and their combination; without labels of both classes all scores are 0.5."""

    def __init__(self, views: list[np.ndarray] | None, calibrations: list[np.ndarray], both: np.ndarray) -> None:
        self.views, self.calibrations, self.both = views, calibrations, both

    def odds(self, x: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([calibrated(*parts) for parts in zip(self.views, self.calibrations, x, strict=True)])

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        if self.views is None:
            return np.full((len(x[0]), 3), 0.5)
        odds = self.odds(x)
        return np.column_stack([probability(odds), probability(self.both[0] + odds @ self.both[1:])])


def surest(views: list[np.ndarray], calibrations: list[np.ndarray], given: tuple[frozenset, frozenset], most: int):
    """A function of Arrow batches of views: per partition, the rows that each view is surest of.

    `given[v]` are the ids that view v gave away already. Columns: task (2 * view + class), doubt, and the row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(4)]
        for batch in batches:
            x, ids = unpacked(batch), batch.column(0).to_pylist()
            for v in (0, 1):
                z = calibrated(views[v], calibrations[v], x[v])
                for k, doubt in ((0, z), (1, -z)):
                    order = np.lexsort((ids, doubt))
                    some = [i for i in order[doubt[order] < -SURE] if ids[i] not in given[v]][:most]
                    held[2 * v + k] += [(float(doubt[i]), ids[i], batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for i in some]
                    held[2 * v + k] = sorted(held[2 * v + k])[:most]
        rows = [(task, *row) for task in range(4) for row in held[task]]
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                              ["task", "doubt", "doc_id", "text_view", "metadata_view"])
    return run


def exchanged(pool: DataFrame, views: list[np.ndarray], calibrations: list[np.ndarray], given: list[set], most: int) -> list[tuple]:
    """What each view hands to the other: (to, ids, classes, both views), as many rows of each class, so that no class drifts.

    Ties go to the smaller id. Repeated rows of an id are one. At most four times `most` rows reach the driver.
    """
    found = pool.mapInArrow(surest(views, calibrations, (frozenset(given[0]), frozenset(given[1])), most),
                            "task int, doubt double, doc_id long, text_view binary, metadata_view binary")
    place = F.row_number().over(Window.partitionBy("task").orderBy("doubt", "doc_id"))
    rows = found.withColumn("place", place).where(F.col("place") <= most).collect()
    out = []
    for v in (0, 1):
        sides = [list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doubt"], r["doc_id"])) if r["task"] == 2 * v + k}.values())
                 for k in (0, 1)]
        n = min(map(len, sides))
        picked = sides[0][:n] + sides[1][:n]
        out.append((1 - v, [r["doc_id"] for r in picked], np.repeat([0.0, 1.0], n), [r[NAMES[1 - v]] for r in picked]))
    return out


def fit(x: list[np.ndarray], y: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS, most: int = HANDED_OVER) -> Model:
    """Co-training from the views `x` of labelled rows, two arrays, and the table of views of unlabelled rows."""
    if len(set(y.tolist())) < 2:
        return Model(None, [], np.zeros(3))
    kept = np.arange(len(y)) % 4 == 3  # for the calibration
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(y), bool)
    own = [(x[v][~kept], y[~kept].astype(float)) for v in (0, 1)]
    given: list[set] = [set(), set()]
    rows = kept if kept.any() else np.ones(len(y), bool)

    def refit() -> tuple[list[np.ndarray], list[np.ndarray]]:
        views = [logistic(a, b) for a, b in own]
        return views, [logistic(raw_odds(views[v], x[v][rows])[:, None], y[rows].astype(float), ridge=0.1) for v in (0, 1)]
    views, calibrations = refit()
    enough = min((y[kept] == k).sum() for k in (0, 1)) >= LEAST_CALIBRATION
    for _ in range(rounds if enough and pool is not None else 0):
        for to, ids, classes, rows_given in exchanged(pool, views, calibrations, given, most):
            if ids:
                own[to] = (np.vstack([own[to][0], [_unpack(r, to) for r in rows_given]]), np.concatenate([own[to][1], classes]))
                given[1 - to] |= set(ids)
        views, calibrations = refit()
    model = Model(views, calibrations, np.zeros(3))
    model.both = logistic(model.odds([a[rows] for a in x]), y[rows].astype(float))
    return model


SIZES = (BUCKETS + 6, 2 * CATEGORIES + 5)
NAMES = ("text_view", "metadata_view")


def _pack(x: np.ndarray) -> bytes:
    """Places and values of the entries that are not zero."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def _unpack(data: bytes, view: int) -> np.ndarray:
    n = len(data) // 6
    x = np.zeros(SIZES[view])
    x[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return x


def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array([_unpack(d, v) for d in batch.column(v + 1).to_pylist()]).reshape(batch.num_rows, SIZES[v]) for v in (0, 1)]


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
        packed = [(_pack(text_view(t, words)), _pack(metadata_view(t, s, g))) for t, s, g in rows]
        yield pa.record_batch([batch.column(0), *(pa.array([p[v] for p in packed], pa.binary()) for v in (0, 1))],
                              ["doc_id", *NAMES])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                found = model.score(unpacked(batch))
                yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)],
                                      ["doc_id", "text_score", "metadata_score", "score"])
    return run


def viewed(docs: DataFrame) -> DataFrame:
    """doc_id and both views of every row, as binary columns, written once."""
    return durable(docs.select("doc_id", "text", "source", "lang").mapInArrow(
        _viewed, "doc_id long, text_view binary, metadata_view binary"))


def train(views: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, rounds: int = ROUNDS) -> Model:
    """Fit to a bounded sample of labelled rows that are not held out, chosen by a hash of the id, and all rows without label."""
    rows = training_sample(views, labels, "quality", rows_per_class, list(NAMES), None)
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"]).encode()))
    x = [np.array([_unpack(r[NAMES[v]], v) for r in rows]).reshape(len(rows), SIZES[v]) for v in (0, 1)]
    marked = sized(labels.where("quality is not null AND doc_id is not null").select("doc_id").distinct(), 16)
    pool = durable(views.where("doc_id is not null").join(marked, "doc_id", "left_anti"))
    return fit(x, np.array([r["label"] for r in rows], int), pool, rounds)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, metadata_score, score, kept and held_out of every row.

    Null and empty texts have no words; null sources and languages are values of their own. Rows are scored one
    by one, so repeated rows agree. Other columns are left out; an empty table gives an empty one.
    """
    views = viewed(docs)
    out = views.mapInArrow(_scored(train(views, labels)), "doc_id long, text_score double, metadata_score double, score double")
    return out.withColumn("kept", F.col("score") >= THRESHOLD).withColumn("held_out", held_out())
