"""Chronological splits and seeded samples, exact, without sorting all rows in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.functions.columns import holds

SORTABLE_ROWS = 100_000


@dataclass(frozen=True)
class Cut:
    """First row that is no longer in front: everything ordered before (date, key) is."""

    date: object
    key: str

    def in_front(self, date: Column, key: Column) -> Column:
        at = F.lit(self.date)
        return holds((date < at) | ((date == at) & (key < self.key)))


def kth_key(keys: DataFrame, position: int, rows: int, sortable: int = SORTABLE_ROWS) -> str:
    """The key with ``position`` smaller keys before it, in byte order. Keys are unique.

    While too many rows share the prefix found so far, count the rows per two more characters and
    follow the branch that holds the position; only a bounded remainder is sorted.
    """
    name = keys.columns[0]
    prefix = ""
    while rows > sortable:
        width = len(prefix) + 2
        branches = (keys.where(F.col(name).startswith(prefix))
                    .groupBy(F.substring(name, 1, width).alias("branch")).agg(F.count("*").alias("n")))
        before = F.sum("n").over(Window.orderBy("branch")) - F.col("n")
        hit = (branches.withColumn("before", before)
               .where((F.col("before") <= position) & (position < F.col("before") + F.col("n"))).first())
        position, rows, prefix = position - hit["before"], hit["n"], hit["branch"]
        if len(prefix) < width:
            return prefix
    place = F.row_number().over(Window.orderBy(name))
    rest = keys.where(F.col(name).startswith(prefix)).withColumn("place", place)
    return rest.where(F.col("place") == position + 1).first()[name]


def rows_per_date(df: DataFrame, date: str = V.DATE) -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("n"))


def cuts_at(df: DataFrame, positions, date: str = V.DATE, key: str = V.KEY,
            sortable: int = SORTABLE_ROWS) -> tuple[int, list[Cut | None]]:
    """Number of rows and the cut at each position of the order (date, key).

    ``positions`` is a function of the number of rows. Dates in front of the cut's date need no
    ranking; only the rows of that one date are searched. None means that all rows are in front.
    """
    # One row per calendar day: small enough for one ordered pass and for the driver.
    per_date = rows_per_date(df, date).where(F.col(date).isNotNull()).orderBy(date).collect()
    total = df.count() if not per_date else sum(r["n"] for r in per_date)
    cuts: list[Cut | None] = []
    for position in positions(total):
        before, cut = 0, None
        for r in per_date:
            if position < before + r["n"]:
                of_date = df.where(F.col(date) == F.lit(r[date])).select(key)
                cut = Cut(r[date], kth_key(of_date, position - before, r["n"], sortable))
                break
            before += r["n"]
        cuts.append(cut)
    return total, cuts


def _labelled(df: DataFrame, cuts: list[Cut | None], names: list[str]) -> Column:
    date, key = F.col(V.DATE), F.col(V.KEY)
    column = F
    for cut, name in zip(cuts, names):
        column = column.when(cut.in_front(date, key) if cut else F.lit(True), name)
    return column.otherwise(names[-1])


def test_positions(total: int, test_from: float = 0.8, burn_in: float = 0.1) -> list[int]:
    """Last 20 % for testing; the first 10 % of the rest warm the histories up and are left out."""
    train_end = int(test_from * total)
    return [int(burn_in * train_end), train_end]


def validation_positions(total: int, burn_in: float = 0.1, train: float = 0.8) -> list[int]:
    start = int(burn_in * total)
    return [start, start + int(train * (total - start))]


def temporal_split(df: DataFrame, test_from: float = 0.8, burn_in: float = 0.1,
                   sortable: int = SORTABLE_ROWS) -> DataFrame:
    """Adds ``split``: burn_in, train or test."""
    _, cuts = cuts_at(df, lambda n: test_positions(n, test_from, burn_in), sortable=sortable)
    return df.withColumn("split", _labelled(df, cuts, ["burn_in", "train", "test"]))


def validation_split(df: DataFrame, burn_in: float = 0.1, train: float = 0.8,
                     sortable: int = SORTABLE_ROWS) -> DataFrame:
    """Adds ``split``: burn_in, train or validation."""
    _, cuts = cuts_at(df, lambda n: validation_positions(n, burn_in, train), sortable=sortable)
    return df.withColumn("split", _labelled(df, cuts, ["burn_in", "train", "validation"]))


def seeded_sample(df: DataFrame, rows: int, seed: int = 1, from_first: float = 0.8,
                  sortable: int = SORTABLE_ROWS, at_most: bool = False) -> DataFrame:
    """``rows`` rows without replacement from the first part of the order (date, key); with ``at_most`` all of that
    part if it has fewer.

    The sample is the rows with the smallest hash of seed and key: the same on every run and for any
    partitioning. The bound is found by counting hash prefixes, so nothing is sorted as a whole.
    """
    total, (end,) = cuts_at(df, lambda n: [int(from_first * n)], sortable=sortable)
    population = int(from_first * total)
    if at_most:
        rows = min(rows, population)
    if rows > population:
        raise ValueError(f"cannot draw {rows} rows from {population}")
    pool = df.where(end.in_front(F.col(V.DATE), F.col(V.KEY))) if end else df
    if rows == population:
        return pool
    draw = F.concat(F.md5(F.concat(F.col(V.KEY), F.lit(f":{seed}"))), F.col(V.KEY))
    bound = kth_key(pool.select(draw.alias("draw")), rows, population, sortable)
    return pool.where(draw < bound)
