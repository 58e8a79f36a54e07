"""The class tree and what follows from it: stages, stage targets, class weights, distances."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.functions.columns import lookup


@dataclass(frozen=True)
class Stage:
    """A parent node and the decision taken there: one classifier over its children."""

    name: str
    depth: int
    labels: tuple[str, ...]

    @property
    def classes(self) -> list[str]:
        return [*self.labels, self.name]


@dataclass
class ClassTree:
    """Tree of class labels. It is a handful of names, so it lives on the driver and reaches the
    tasks as literals of the expressions below."""

    root: str
    parents: dict[str, str] = field(default_factory=dict)

    def add(self, children: list[str], parent: str) -> "ClassTree":
        self.parents.update(dict.fromkeys(children, parent))
        return self

    @classmethod
    def satisfaction(cls) -> "ClassTree":
        tree = cls(V.ROOT)
        for children, parent in V.TREE_EDGES:
            tree.add(children, parent)
        return tree

    def flat(self) -> "ClassTree":
        """The same leaves directly under the root."""
        return ClassTree(self.root).add(self.leaves(), self.root)

    def children(self, node: str) -> list[str]:
        return sorted(c for c, p in self.parents.items() if p == node)

    def leaves(self) -> list[str]:
        inner = set(self.parents.values())
        return [n for n in self.parents if n not in inner]

    def internal(self) -> list[str]:
        """Parents without the root."""
        inner = set(self.parents.values())
        return [n for n in self.parents if n in inner and n != self.root]

    def nodes(self) -> list[str]:
        """All nodes but the root."""
        return self.leaves() + self.internal()

    def parent(self, node: str) -> str:
        return self.root if node == self.root else self.parents.get(node, self.root)

    def ancestors(self, node: str) -> list[str]:
        """From the parent upwards, without the root."""
        above = self.parent(node)
        return [] if above == self.root else [above, *self.ancestors(above)]

    def descendants(self, node: str) -> list[str]:
        return [d for c in self.children(node) for d in (c, *self.descendants(c))]

    def distance(self, a: str, b: str) -> int:
        """Edges on the way from one node to the other. An edge is named by its lower end."""
        def edges(n: str) -> set[str]:
            return set() if n == self.root else {n, *self.ancestors(n)}
        return len(edges(a) ^ edges(b))

    def stages(self) -> list[Stage]:
        """Depth first, children by name."""
        def below(node: str, depth: int) -> list[Stage]:
            kids = self.children(node)
            if not kids:
                return []
            return [Stage(node, depth, tuple(kids))] + [s for k in kids for s in below(k, depth + 1)]
        return below(self.root, 0)

    def seen_by(self, stage: Stage, label: str) -> str:
        """The class a stage sees for a label: the first node upwards that the stage knows."""
        while label != self.root and label not in stage.classes:
            label = self.parent(label)
        return label

    # --- as expressions and tables ----------------------------------------------------------

    def node_set(self, node: Column) -> Column:
        """The node and its ancestors, without the root; a root stands for itself."""
        listed = [self.root, *self.parents]
        pairs = [x for n in listed for x in (
            F.lit(n), F.array(*[F.lit(a) for a in (n, *self.ancestors(n))]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), node), F.array(node))

    def distance_between(self, a: Column, b: Column) -> Column:
        def edges(n: Column) -> Column:
            return F.array_remove(self.node_set(n), self.root)
        return (F.size(F.array_except(edges(a), edges(b)))
                + F.size(F.array_except(edges(b), edges(a))))

    def is_leaf(self, node: Column) -> Column:
        return F.coalesce(node.isin(self.leaves()), F.lit(False))

    def is_internal(self, node: Column) -> Column:
        return F.coalesce(node.isin(self.internal()), F.lit(False))

    def target(self, stage: Stage, label: Column) -> Column:
        """What the stage sees for a label; NULL if the row does not belong to the stage."""
        seen = {n: self.seen_by(stage, n) for n in [self.root, *self.parents]}
        return lookup({n: s for n, s in seen.items() if s in stage.classes}, label, "string")

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Closure: every node with itself and each node above it, the root included."""
        rows = []
        for node in [self.root, *self.parents]:
            path = [node] if node == self.root else [node, *self.ancestors(node), self.root]
            rows += [(node, above, steps, not self.children(node)) for steps, above in enumerate(path)]
        return spark.createDataFrame(rows, "node string, ancestor string, distance int, is_leaf boolean")


def orders_per_node(labels: DataFrame, tree: ClassTree, label: str = V.LABEL) -> DataFrame:
    """How many rows lie under every node of the tree; labels are counted before the closure join."""
    counts = labels.groupBy(F.col(label).alias("node")).agg(F.count("*").alias("n"))
    closure = tree.to_df(labels.sparkSession)
    return counts.join(closure, "node").groupBy("ancestor").agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("distance").alias("height"))


def stage_targets(df: DataFrame, tree: ClassTree, label: str = V.LABEL) -> DataFrame:
    """(key, stage, target): every row once per stage it takes part in. No shuffle."""
    per_stage = F.array(*[F.struct(F.lit(s.name).alias("stage"),
                                   tree.target(s, F.col(label)).alias("target"))
                          for s in tree.stages()])
    return df.select(V.KEY, F.inline(per_stage)).where(F.col("target").isNotNull())


def class_weights(df: DataFrame, tree: ClassTree, label: str = V.LABEL) -> DataFrame:
    """Balanced weights per stage: rows / (classes * rows of the class)."""
    counts = stage_targets(df, tree, label).groupBy("stage", "target").agg(F.count("*").alias("n"))
    stage = Window.partitionBy("stage")
    return counts.withColumn(
        "weight", F.sum("n").over(stage) / (F.count("*").over(stage) * F.col("n")))
