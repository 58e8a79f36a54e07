"""Mixing sources to target numbers of words by entropy balancing.

Every document gets a rate between 0 and `MOST` copies. Among all rates that give each source its target words,
those with the least bounded relative entropy to one copy per document are taken; they are the exponential tilt
rate = MOST / (1 + (MOST - 1) * exp(-lambda * size / mean size)) with one lambda per source, the variable of the
convex dual. Newton steps, kept inside a bracket, solve the dual: each is one grouping of the counts per (source,
size), which are summed once. Rates become copies by a seeded hash, and what the hash leaves open between the
copies and the target is closed by moving the rounding threshold of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import BROADCAST_BYTES, durable, sized, words_between
from ordersight.session import written

MOST = 3
STEPS = 60
TOLERANCE = 1e-9
BINS = 4096
SEED = 4


def word_count(text: Column) -> Column:
    return F.size(words_between(text, r"[\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to the same with `weight`, `limit` and `target`.

    Weights 1, 2, 3 repeat over the sources by code point, null last. The targets share all words by weight;
    where a share passes `MOST` times its source it stops there and the rest is shared anew. The sources that
    stop are those with the least limit per weight, so one cumulative pass finds them. One row per source goes
    through the window, never a row per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.select("source", "source_size", ((F.row_number().over(order) - 1) % 3 + 1).alias("weight"),
                             (F.col("source_size") * MOST).alias("limit"))
    tight = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    words = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumns({"level": words / weight, "no": F.row_number().over(tight)})
    # Levels rise while sources stop, so the first that does not stop has the final level.
    goes_on = F.col("limit") > F.col("level") * F.col("weight")
    final = F.min(F.when(goes_on, F.struct("no", "level"))).over(everything)["level"]
    return level.select("source", "source_size", "weight", "limit", F.least(
        F.col("limit").cast("double"), F.coalesce(final * F.col("weight"), F.col("limit"))).alias("target"))


def _rate(size: Column, mean: Column, lam: Column) -> Column:
    return MOST / (1 + (MOST - 1) * F.exp(F.greatest(F.least(-lam * size / mean, F.lit(700.0)), F.lit(-700.0))))


def _tilts(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Lambda of every source. Sources at their limit need none: all their rates are `MOST`.

    The state of a step is written as a table: a checkpoint keeps the conditions that the plan has inferred, and
    they double with every step.
    """
    state = durable(goals.withColumn("lam", F.lit(0.0)).withColumn("low", F.lit(-1e9)).withColumn("high", F.lit(1e9))
                    .withColumn("open", (F.col("target") < F.col("limit")) & (F.col("source_size") > 0)))
    for _ in range(STEPS):
        rows, unsolved = state.agg(F.count("*"), F.count_if("open")).first()
        if not unsolved:
            break
        small = F.broadcast(state) if rows * 100 <= BROADCAST_BYTES else state
        h = histogram.alias("h").join(small.where("open").alias("s"), F.expr("h.source <=> s.source"))
        rate = _rate(F.col("size"), F.col("mean"), F.col("lam"))
        slope = rate * (1 - rate / MOST) * F.col("size") / F.col("mean")
        sums = h.groupBy(F.col("s.source").alias("of")).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        off = F.col("words") - F.col("target")
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        reach = 2 + F.abs("lam")
        step = F.greatest(F.least(-off / F.greatest("slope", F.lit(1e-300)), reach), -reach)
        newton = F.col("lam") + step
        middle = (low + high) / 2
        moved = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        still = F.abs(off) > F.greatest(F.col("target") * TOLERANCE, F.lit(1e-6))
        joined = state.join(sums, F.expr("source <=> of"), "left")
        state = written(joined.select(
            "source", "source_size", "weight", "limit", "target", "mean",
            F.when(F.col("open") & still, moved).otherwise(F.col("lam")).alias("lam"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
            (F.col("open") & F.coalesce(still, F.lit(False))).alias("open")), "tilts")
    return state.drop("low", "high", "open")


def _drawn(rows: DataFrame) -> DataFrame:
    """Adds `rate`, the place `v` = rate + u of its rounding, and the copies before any shift."""
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(SEED)), 11) / F.lit(float(2**53))
    rate = F.when(F.col("target") >= F.col("limit"), F.lit(float(MOST))).otherwise(
        _rate(F.col("size"), F.col("mean"), F.col("lam")))
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    v = F.col("rate") + F.when(F.col("rate") >= MOST, F.lit(0.0)).otherwise(u)
    rows = rows.withColumn("v", v)
    return rows.withColumn("copies", F.least(F.floor("v"), F.lit(MOST)))


def _bins(up: bool) -> tuple[Column, Column]:
    """Bin of the shift at which a row gains (or loses) a copy, and whether it can."""
    part = F.col("v") - F.floor("v")
    if up:
        return F.floor((1 - part) * (BINS - 1)).cast("int"), F.col("copies") < MOST
    return F.floor(part * (BINS - 1)).cast("int"), F.col("copies") > 0


class Mix:
    """Rates and rounding of every source, fitted to (doc_id, text_key, source, size) rows."""

    def __init__(self, rows: DataFrame) -> None:
        histogram = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
        per = histogram.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size")).alias("source_size"),
            (F.sum(F.when(F.col("size") > 0, F.col("n") * F.col("size"))) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean"))
        per = durable(per.withColumn("mean", F.coalesce("mean", F.lit(1.0))))
        goals = targets(per).join(per.select(F.col("source").alias("of"), "mean"), F.expr("source <=> of")).drop("of")
        tilts = _tilts(histogram, goals)
        self.sources = sized(tilts.withColumn("up", F.lit(True)).withColumn("bin", F.lit(-1)), 120)
        drawn = self._attach(rows)
        taken = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        short = durable(tilts.join(taken.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
                        .withColumn("need", F.col("target") - F.col("taken")).withColumn("up", F.col("need") > 0))
        side = sized(short.select(F.col("source").alias("of"), F.col("up").alias("_up")), 40)
        (up_bin, can_gain), (down_bin, can_lose) = _bins(True), _bins(False)
        moves = (drawn.drop("up", "bin").join(side, F.expr("source <=> of"))
                 .where(F.when(F.col("_up"), can_gain).otherwise(can_lose) & (F.col("size") > 0))
                 .groupBy("of", F.when(F.col("_up"), up_bin).otherwise(down_bin).alias("bin"))
                 .agg(F.sum("size").alias("words")))
        running = moves.withColumn("sum", F.sum("words").over(Window.partitionBy("of").orderBy("bin")))
        # The shift ends at the bin that comes nearest to the need; -1 is no shift.
        near = running.join(short.select(F.col("source").alias("_s"), F.abs("need").alias("gap")), F.expr("of <=> _s"))
        best = near.groupBy("of").agg(F.min(F.struct(F.abs(F.col("sum") - F.col("gap")).alias("off"), "bin")).alias("b"),
                                      F.first("gap").alias("gap"))
        shifts = best.select("of", F.when(F.col("b.off") < F.col("gap"), F.col("b.bin")).otherwise(-1).alias("bin"))
        moved = durable(short.join(shifts, F.expr("source <=> of"), "left").select(
            "source", "source_size", "weight", "limit", "target", "mean", "lam", "up", F.coalesce("bin", F.lit(-1)).alias("bin"),
            F.lit(None).cast("long").alias("last_id"), F.lit(None).cast("long").alias("last_key"), F.lit(0).alias("last")))
        self.sources = sized(moved, 150)
        self.sources = sized(self._last(moved, rows), 150)

    def _last(self, moved: DataFrame, rows: DataFrame) -> DataFrame:
        """One more copy, given or taken, per source: of the document whose size is nearest to what is still open."""
        taken = self._attach(rows)
        sums = taken.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
        still = sized(moved.join(sums, F.expr("source <=> of")).select(
            "of", (F.col("target") - F.col("words")).alias("need")), 40)
        can = F.when(F.col("need") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        off = F.abs(F.col("size") - F.abs("need"))
        best = (taken.join(still, F.expr("source <=> of")).where(can & (F.col("size") > 0) & (off < F.abs("need")))
                .groupBy("of").agg(F.min(F.struct(off.alias("off"), "doc_id", "text_key")).alias("b"), F.first("need").alias("need")))
        return moved.drop("last_id", "last_key", "last").join(best, F.expr("source <=> of"), "left").select(
            *moved.columns[:-3], F.col("b.doc_id").alias("last_id"), F.col("b.text_key").alias("last_key"),
            F.coalesce(F.signum("need").cast("int"), F.lit(0)).alias("last"))

    def _attach(self, rows: DataFrame) -> DataFrame:
        mine = self.sources.withColumnRenamed("source", "_of")
        drawn = _drawn(rows.join(mine, F.expr("source <=> _of")).drop("_of"))
        if "last" not in mine.columns:
            return drawn
        (up_bin, can_gain), (down_bin, can_lose) = _bins(True), _bins(False)
        more = F.when(F.col("up") & can_gain & (up_bin <= F.col("bin")) & (F.col("size") > 0), 1)
        less = F.when(~F.col("up") & can_lose & (down_bin <= F.col("bin")) & (F.col("size") > 0), -1)
        last = F.when((F.col("text_key") == F.col("last_key")) & F.expr("doc_id <=> last_id"), F.col("last")).otherwise(0)
        return drawn.withColumn("copies", (F.col("copies") + F.coalesce(more, less, F.lit(0)) + last).cast("long"))

    def copies(self, rows: DataFrame) -> DataFrame:
        """Adds source_size, target, rate and copies to rows with doc_id, text_key, source and size."""
        return self._attach(rows).drop("weight", "limit", "mean", "lam", "up", "bin", "v", "last_id", "last_key", "last")


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size) of every row; a null text has no words, a null source is one of its own."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))


def balanced(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) to doc_id, source, size, source_size, target, rate, copies: one row per row.

    Texts without words have a rate of one copy. Repeated rows draw the same copies. Other columns are left out;
    an empty table gives an empty one.
    """
    rows = durable(sized_rows(docs))
    return Mix(rows).copies(rows).drop("text_key")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their columns.

    Copies are found from the source and the size of each row, so the texts are not shuffled.
    """
    mix = Mix(durable(sized_rows(docs)))
    columns = docs.columns
    own = docs.withColumns({"text_key": F.xxhash64("text"), "size": word_count(F.col("text"))})
    out = mix.copies(own.select(F.struct(*columns).alias("row"), "doc_id", "source", "text_key", "size"))
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return out.withColumn("copy", F.explode(times)).select("row.*")
