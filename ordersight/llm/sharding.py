"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are spread over source parts by a hash of their id and text. How many rows of a part go to which shard is
drawn without replacement from the places left in the shards (a multivariate hypergeometric row per part), so
the shard sizes are exact and the counts are those of a uniform shuffle. A seeded permutation inside the part
tells which rows go where; after the exchange a second permutation gives the slots. Both permutations run over
pieces of about `ROWS_PER_PIECE` rows, so no task holds a whole shard. The driver draws one row of the matrix
per piece: numbers of pieces and shards, never rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import durable

SHARDS = 24
ROWS_PER_PIECE = 100_000
LEAST_PIECES = 16
SEED = 20
#: numpy draws hypergeometric counts only below this.
LIBRARY_BOUND = 1_000_000_000
DEVIATIONS = 12


def matrix(part_rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows of each part for each shard; columns sum to sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(part_rows)
    left = np.full(shards, total // shards, np.int64)
    left[:total % shards] += 1
    out = np.zeros((len(part_rows), shards), np.int64)
    for p, rows in enumerate(part_rows):
        out[p] = _draw(rng, left, rows)
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, rows: int) -> np.ndarray:
    """One multivariate hypergeometric row by its marginals, shard after shard."""
    taken, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, here in enumerate(left.tolist()):
        rest -= here
        if rows and here:
            taken[s] = _hypergeometric(rng, here, rest, rows) if rest else rows
            rows -= int(taken[s])
    return taken


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good; for any numbers.

    The library draws below a billion on either side. Beyond that the shares of the outcomes around the mode follow
    from the ratios of neighbours, and one uniform number picks an outcome. Those left out, more than `DEVIATIONS`
    deviations away, weigh less together than the last digit of a double.
    """
    if max(good, bad) < LIBRARY_BOUND:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    share = good / total
    deviation = math.sqrt(n * share * (1 - share) * (total - n) / max(total - 1, 1))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = math.ceil(DEVIATIONS * deviation) + 20
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=float)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def _numbered(docs: DataFrame) -> DataFrame:
    """(k1, k2) of all columns to one narrow row per row of the table, with a number among equal rows.

    Equal rows are counted before they are numbered, so a row that is repeated without end costs one row per
    task in the shuffle, and its numbers come from ranges of a thousand.
    """
    copies = docs.groupBy("_k1", "_k2").count()
    thousands = copies.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / 1000))))
    low, high = F.col("_t") * 1000, F.least(F.col("_t") * 1000 + 999, F.col("count") - 1)
    return thousands.select("_k1", "_k2", F.explode(F.sequence(low, high)).alias("_copy"))


def assigned(numbered: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(_k1, _k2, _copy), all distinct, to the same with `shard` and `slot`."""
    base = durable(numbered.withColumn("_h", F.xxhash64("_k1", "_k2", "_copy", F.lit(seed))))
    rows = base.count()
    pieces = max(LEAST_PIECES, -(-rows // ROWS_PER_PIECE))
    base = base.withColumn("_part", F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(pieces)).cast("int"))
    counts = {r["_part"]: r["count"] for r in base.groupBy("_part").count().collect()}
    upto = np.cumsum(matrix([counts.get(p, 0) for p in range(pieces)], shards, seed), 1)
    dealt = base.sparkSession.createDataFrame(
        [(p, upto[p].tolist()) for p in range(pieces)], "_part int, _upto array<long>")
    order = ["_k1", "_k2", "_copy"]
    first = Window.partitionBy("_part").orderBy("_h", *order)
    sent = (base.withColumn("_rank", F.row_number().over(first)).join(F.broadcast(dealt), "_part")
            .withColumn("shard", F.size(F.filter("_upto", lambda u: u < F.col("_rank"))))
            .select(*order, "shard", F.xxhash64("_h", "shard", F.lit(2)).alias("_h2")))
    # The second permutation orders a shard by pieces and inside a piece by another hash.
    inner = max(1, -(-rows // (shards * ROWS_PER_PIECE)))
    sent = durable(sent.withColumn("_piece", F.pmod(F.xxhash64("_h2", F.lit(3)), F.lit(inner)).cast("int")))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(sent.groupBy("shard", "_piece").count().select(  # one row per task, not per row
        "shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))
    second = Window.partitionBy("shard", "_piece").orderBy("_h2", *order)
    placed = sent.withColumn("_place", F.row_number().over(second)).join(F.broadcast(starts), ["shard", "_piece"])
    return placed.select(*order, "shard", (F.col("_start") + F.col("_place") - 1).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to all rows of a table.

    Only keys of rows are permuted and exchanged; the columns join them once at the end. Nulls hash like any
    value, equal rows are told apart by a number and get places of their own, and the result depends on the rows
    alone, not on the order they are read in. Columns named `shard` or `slot` are replaced. An empty table gives
    an empty one.
    """
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    keyed = docs.withColumn("_k1", F.xxhash64(*columns)).withColumn("_k2", F.xxhash64(F.lit(seed), *columns))
    places = assigned(_numbered(keyed.select("_k1", "_k2")), shards, seed)
    return (keyed.dropDuplicates(["_k1", "_k2"]).join(places, ["_k1", "_k2"])
            .select(*columns, "shard", "slot"))
