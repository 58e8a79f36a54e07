"""Top-down routing of scored rows through the tree, and carrying decisions over the days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.functions.columns import holds, lookup
from ordersight.operators.hierarchy import ClassTree


def score_column(node: str) -> str:
    return "p_" + node.replace(" ", "_")


def winner(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Highest score and its class, the first by name on ties; NULL if nothing is scored."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    label = F
    for name in sorted(scores):
        label = label.when(scores[name] == best, name)
    return best, label


def limit_for(label: Column, thresholds: dict[str, float] | float | None) -> Column | None:
    if thresholds is None:
        return None
    if isinstance(thresholds, dict):
        return F.coalesce(lookup(thresholds, label, "double"), F.lit(float("inf")))
    return F.lit(float(thresholds))


def route(scored: DataFrame, tree: ClassTree, thresholds: dict[str, float] | float | None = None,
          pred: str = "pred") -> DataFrame:
    """Adds the node each row ends at. A stage passes a row on if the winning class reaches its
    threshold (per node, or one for all); without thresholds every row reaches a leaf. No shuffle."""
    out = scored.withColumn(pred, F.lit(tree.root))
    for stage in tree.stages():
        best, label = winner({c: F.col(score_column(c)) for c in stage.labels})
        limit = limit_for(label, thresholds)
        passed = label.isNotNull() if limit is None else holds(best >= limit)
        out = out.withColumn(pred, F.when((F.col(pred) == stage.name) & passed, label)
                             .otherwise(F.col(pred)))
    return out


def blocking(routed: DataFrame, tree: ClassTree, pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """(stage, scored, blocked, share): rows that came to a stage and rows that stayed there."""
    counts = routed.groupBy(*by, F.col(pred).alias("node")).agg(F.count("*").alias("n"))
    reached = [F.struct(F.lit(s.name).alias("stage"),
                        F.col("node").isin([s.name, *tree.descendants(s.name)]).alias("came"),
                        (F.col("node") == s.name).alias("stayed")) for s in tree.stages()]
    long = counts.select(*by, "n", F.inline(F.array(*reached)))
    out = long.groupBy(*by, "stage").agg(F.coalesce(F.sum(F.when(F.col("came"), F.col("n"))), F.lit(0)).alias("scored"),
                                         F.coalesce(F.sum(F.when(F.col("stayed"), F.col("n"))), F.lit(0)).alias("blocked"))
    return out.withColumn("share", F.try_divide("blocked", "scored"))


def carry_over(routed: DataFrame, tree: ClassTree) -> DataFrame:
    """From a route per row and day to the history of rows still open on each day.

    Output (key, day, label, pred, prev): a row appears until the day it reaches a leaf; ``prev`` is
    the internal node it was blocked at the day before. At most one row per day meets in a window.
    """
    earlier = Window.partitionBy(V.KEY).orderBy("day")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    decided = F.coalesce(F.bool_or(tree.is_leaf(F.col("pred"))).over(before), F.lit(False))
    blocked = F.when(tree.is_internal(F.col("pred")), F.col("pred"))
    return (routed.select(V.KEY, "day", "label", "pred", decided.alias("decided"),
                          F.lag(blocked).over(earlier).alias("prev"))
            .where(~F.col("decided")).drop("decided"))
