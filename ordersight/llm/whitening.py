"""PCA whitening of vectors: float32 eigenvectors of a distributed covariance, refined in higher precision.

The refinement is that of Ogita and Aishima: from approximate eigenvectors X of A one forms R = I - X'X and
S = X'AX, reads improved eigenvalues and a correction E from them, and sets X to X + XE. It needs matrix products only
and converges quadratically. Where eigenvalues lie so close that E has no safe denominator, their vectors span the
right space but are mixed in it; a sub-solve of the small shifted matrix of that space parts them.

Odd rows: a vector that is null, or holds a null, NaN or infinite entry, is left out. So is one of another length than
most have (the longer length at a tie), and an empty one. Repeated rows count once in the fit and are all returned.
Components without variance are left out, so equal vectors give no component at all. Columns named `_x`, `deviation` or
`whitened` are replaced; all others are returned as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable

SCALE = 256
COMPONENTS = 4
STEPS = 12
#: Components with less than this share of the variance have none.
NO_VARIANCE = 1e-12
VALUE = "k long, value double"


def _one_step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Refined vectors, eigenvalues, which pairs were too close, and the size of the correction."""
    eye = np.eye(x.shape[1], dtype=x.dtype)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    safe = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= safe
    # (s + value_j r) / gap, written as r / 2 and a turn, which is exactly antisymmetric and so keeps right angles.
    turn = np.where(close, 0, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(close, 1, gap))
    e = r / 2 + turn
    return x + x @ e, values, close, float(np.abs(e).max(initial=0))


def _clusters(close: np.ndarray) -> list[np.ndarray]:
    """Groups of two and more neighbours, in the order of the eigenvalues, that are joined by closeness."""
    out, start = [], 0
    for i in range(1, len(close) + 1):
        if i == len(close) or not close[:i, i:].any():
            if i - start > 1:
                out.append(np.arange(start, i))
            start = i
    return out


def refined(a: np.ndarray, steps: int = STEPS, kind=np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors of a symmetric matrix, to the precision of `kind`."""
    a = np.asarray(a, kind)
    if not len(a):
        return np.zeros(0, kind), np.zeros((0, 0), kind)
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(len(a), kind), np.eye(len(a), dtype=kind)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(kind)
    tiny = 8 * np.finfo(kind).eps
    last = np.inf
    for step in range(steps):
        x, values, close, size = _one_step(a, x)
        if size <= tiny or step > 4 and size > last / 2:
            break  # what is left is rounding
        last = size
        np.fill_diagonal(close, False)
        # Once the rest has settled, what is still close needs its own solve: the matrix of the space, less its
        # mean eigenvalue, has entries as small as the gaps, so that float32 vectors part them.
        if close.any() and np.abs(np.eye(len(a)) - x.T @ x).max() < 1e-10:
            for own in _clusters(close):
                y = x[:, own]
                inner = y.T @ (a @ y) - values[own].mean() * (y.T @ y)
                size_of = np.abs(inner).max()
                if size_of > tiny:
                    w = np.linalg.eigh((inner / size_of).astype(np.float32))[1][:, ::-1].astype(kind)
                    for _ in range(3):
                        w = _one_step(inner / size_of, w)[0]
                    x[:, own] = y @ w
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.sqrt((x * x).sum(0))


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch; every one of them has the same length, stored as little-endian longs."""
    cells = batch.column(batch.schema.names.index("_x")).to_pylist()
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), -1)


def quantised(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector, and `_x`: the bytes of its entries, scaled and rounded down to longs."""
    v = F.col(vector)
    usable = df.where(v.isNotNull() & (F.size(v) > 0))
    names, place = usable.columns, usable.columns.index(vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema) + ", _x binary"

    def convert(batches):
        for batch in batches:
            column = batch.column(place)
            sizes = np.diff(column.offsets.to_numpy())
            entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            good = bad[ends] == bad[ends - sizes]
            limit = float(1 << 62)
            x = np.floor(np.clip(np.nan_to_num(scale * entries), -limit, limit)).astype("<i8").tobytes()
            cells = [x[8 * (b - n):8 * b] for b, n in zip(ends.tolist(), sizes.tolist())]
            full = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], [*names, "_x"])
            yield full.filter(pa.array(good))

    found = usable.mapInArrow(convert, schema)
    # The length that most have; one number per length reaches the driver.
    lengths = usable.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.where(F.length("_x") == 8 * (lengths["n"] if lengths else 0))


def _summed(rows: DataFrame, of_block) -> dict[int, float]:
    """Sum of small arrays over all partitions, by the number of the entry; the driver gets one row per entry."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_block(_whole(batch))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64))], ["k", "value"])
    found = rows.select("_x").mapInArrow(run, VALUE).groupBy("k").agg(F.sum("value").alias("value"))
    return {r["k"]: r["value"] for r in found.collect()}


@dataclass
class Whitening:
    """What was fitted: rows, exact sums, eigenvalues, vectors as columns, and how far whitened data is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(rows: DataFrame, components: int = COMPONENTS, no_variance: float = NO_VARIANCE) -> Whitening:
    """Fit on the distinct vectors of `rows`, as `quantised` makes them."""
    # A vector that many rows share is one row before the shuffle.
    distinct = durable(rows.select("_x").distinct())

    def exact_sums(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch)
                n += len(x)
                # High and low halves, so that a partition's sums cannot overflow.
                part = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
                total = part if total is None else total + part
        if total is not None:
            high, low = total
            yield pa.record_batch([pa.array(np.arange(-1, len(high))), pa.array(np.concatenate([[0], high])),
                                   pa.array(np.concatenate([[n], low]))], ["k", "high", "low"])

    got = {r["k"]: (int(r["high"]) << 32) + int(r["low"]) for r in distinct.mapInArrow(
        exact_sums, "k long, high long, low long").groupBy("k").agg(
            F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
            F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()}
    if not got:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    n, sums = got[-1], [got[k] for k in range(len(got) - 1)]
    d = len(sums)
    mean = np.array([s / n for s in sums])

    def outer(x):
        centred = x - mean
        return centred.T @ centred

    entries = _summed(distinct, outer)
    v = np.array([entries[k] for k in range(d * d)]).reshape(d, d) / n
    values, vectors = refined(v)
    trace = float(np.trace(v))
    kept = int(min(components, (values > no_variance * trace).sum())) if trace > 0 else 0
    values, vectors = values[:kept].astype(float), vectors[:, :kept].astype(float)
    map_ = vectors / np.sqrt(values)

    def white(x):
        z = (x - mean) @ map_
        return z.T @ z

    error = 0.0
    if kept:
        entries = _summed(distinct, white)
        found = np.array([entries[k] for k in range(kept * kept)]).reshape(kept, kept) / n
        error = float(np.abs(found - np.eye(kept)).max())
    return Whitening(n, sums, values, vectors, trace, error)


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """Adds `deviation`, the sum over the dimensions of (n x - sum)^2, and `whitened`, one double per component."""
    n, sums = model.n, model.sums
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)
    map_ = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((len(sums), 0))
    names = [c for c in rows.columns if c != "_x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_x")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch)
            most = int(max(abs(int(x.min())), abs(int(x.max())))) * n + max(map(abs, sums))
            if len(sums) * most * most < 1 << 63:
                deviation = pa.array(((n * x - np.array(sums)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                from decimal import Decimal
                deviation = pa.array([Decimal(sum((n * e - s) ** 2 for e, s in zip(row, sums))) for row in x.tolist()],
                                     pa.decimal128(38, 0))
            z = (x - mean) @ map_
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), z.ravel())
            kept = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.record_batch([*kept, deviation, cells], [*names, "deviation", "whitened"])

    return rows.mapInArrow(run, f"{schema}, deviation decimal(38,0), whitened array<double>")


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
             ) -> tuple[DataFrame, Whitening]:
    """The usable rows with `deviation` and `whitened`, and the fit on their distinct vectors."""
    rows = quantised(df.drop(*{"_x", "deviation", "whitened"} - {vector}), vector, scale)
    model = fit(rows, components)
    return transformed(rows, model), model
