"""What the operators of this package share: tables, durable cuts, measured joins, row keys."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.session import shared_folder

#: A side is sent to all executors only if its rows, measured, stay below this many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024


#: Seconds between two collections of the driver's garbage, at least.
COLLECT_EVERY = 5.0
_COLLECTED = {"at": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share; Spark removes the files with the table."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    _collect(df.sparkSession)
    return out


def _collect(spark: SparkSession) -> None:
    """Have the driver's JVM drop the plans of steps that are over, and with them their shuffle files and broadcasts.

    By itself it lets the heap grow to its bound before it does, however little of it is in use: steps of many small jobs
    fill it with plans.
    """
    now = time.monotonic()
    if now - _COLLECTED["at"] >= COLLECT_EVERY:
        _COLLECTED["at"] = now
        spark.sparkContext._jvm.java.lang.System.gc()


def _bytes_of(df: DataFrame) -> Column:
    """Length of what a row holds beyond numbers: texts by their bytes, nested values as they would be printed."""
    parts = [F.lit(0)]
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind in ("array", "struct", "map"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
    return reduce(add, parts).cast("long")


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows stay below the bound: `row_bytes` for each, and the measured bytes of its texts."""
    n, held = df.agg(F.count("*"), F.sum(_bytes_of(df))).first()
    return n * row_bytes + (held or 0) <= BROADCAST_BYTES


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A durable table, marked for broadcast only where its measured size is below the bound.

    A larger one is left to a shuffle join, in which adaptive execution splits hot keys.
    """
    df = durable(df)
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def words_between(text: Column, separators: str) -> Column:
    """Words between runs of separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII texts take the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    """Values of a column; the column is bytes where the query cast it to binary."""
    return batch.column(batch.schema.names.index(name)).to_pylist()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled ids that may be learned from; conflicting labels of an id count as 1."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out())
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Ids per class among all labelled rows that may be learned from."""
    return {r["label"]: r["count"] for r in _learned_ids(labels, label).groupBy("label").count().collect()}


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int,
                    columns: list[str], longest: int | None = 100_000) -> list:
    """At most `rows_per_class` labelled documents of each class, chosen by a hash of the id.

    The ids are chosen in `labels` alone, so the documents are scanned once, against a broadcast of at
    most twice `rows_per_class` ids. Held-out rows and texts of more than `longest` characters are never
    among them (None: no bound, no text column). Conflicting labels of an id count as 1.
    """
    ids = _learned_ids(labels, label)
    parts = [ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
             for k in (0, 1)]
    chosen = durable(parts[0].union(parts[1]).coalesce(1))
    found = docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id")
    if longest is not None:
        found = found.where(F.length(F.coalesce("text", F.lit(""))) <= longest)
    return sorted(found.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])


def each_batch(f):
    """A function of one Arrow batch as the iterator function that mapInArrow takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)
    return run
