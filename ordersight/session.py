"""Session defaults, the shared folder for cut lineages, and joins with a measured side."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: What holds while a durable table is written: the bytecode of a method beyond which the JVM never compiles it, and that the
#: shuffle files of the write go as soon as it is done, since nothing reads them again.
WRITE_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_LOCK = threading.Lock()
_OPEN: dict = {"calls": 0, "before": None}


def local_session(cores: str = "*", name: str = "ordersight", memory: str = "12g") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ordersight-"))
        # Wide selects outgrow what the JVM compiles; split projections run several times faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording the call site of every column expression costs several round trips each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors must share.

    Where none is named, a temporary one is used in a single process only; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"Set spark.checkpoint.dir to a folder that all executors share (master {master})")
        named = tempfile.mkdtemp(prefix="ordersight-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Writes run inside split wide selects that the JVM would otherwise interpret, and leave no shuffle files behind; the
    session's settings come back."""
    # Writes of several threads may overlap: the first sets, the last puts back.
    with _LOCK:
        if _OPEN["calls"] == 0:
            _OPEN["before"] = {name: spark.conf.get(name, None) for name in WRITE_CONF}
            for name, value in WRITE_CONF.items():
                spark.conf.set(name, value)
        _OPEN["calls"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _OPEN["calls"] -= 1
            if _OPEN["calls"] == 0:
                for name, before in _OPEN["before"].items():
                    spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def write_scratch(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> str:
    """Write the rows to a new folder in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with compiled(df.sparkSession):
        writer.parquet(path)
    return path


def written(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: a durable cut of the lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name, partition_by))


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], name: str,
                limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Left join with a table that is usually small.

    The table is written once and its rows are counted; it is broadcast only if the counted size is
    below the limit. A larger table is joined by shuffle, where adaptive execution splits hot keys.
    """
    table = written(table, name)
    doubles = table.schema.simpleString().count("double") + 4 * len(table.columns)
    if table.count() * 8 * doubles <= limit_bytes:
        table = F.broadcast(table)
    return rows.join(table, on, "left")
