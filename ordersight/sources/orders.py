"""Order-line files: yearly CSV exports in, prepared table and metrics out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions.values import KEY
from ordersight.session import compiled

DATES = ["orderDate", "cancellationDate", "promisedDeliveryDate", "shipmentDate", "startDateCase",
         "registrationDateSeller"]
MOMENTS = ["datetTimeFirstDeliveryMoment", "returnDateTime"]
FLAGS = ["calculationDefinitive", "noCancellation", "noCase", "hasOneCase", "hasMoreCases", "noReturn"]
STATES = ["onTimeDelivery"]
MEASURES = ["totalPrice", "quantityOrdered", "quanityReturned"]
WHOLES = ["cntDistinctCaseIds"]
IDS = ["productId", "sellerId"]
TEXTS = ["productTitle", "productGroup", "fulfilmentType", "countryCode", "countryOriginSeller",
         "transporterCode", "cancellationReasonCode", "returnCode", "generalMatchClassification",
         "detailedMatchClassification"]

RAW_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType(), False)]
    + [T.StructField(c, T.DateType()) for c in DATES]
    + [T.StructField(c, T.TimestampType()) for c in MOMENTS]
    + [T.StructField(c, T.BooleanType()) for c in FLAGS + STATES]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    + [T.StructField(c, T.IntegerType()) for c in WHOLES]
    + [T.StructField(c, T.LongType()) for c in IDS]
    + [T.StructField(c, T.StringType()) for c in TEXTS])


def _parsed(text: Column, kind: T.DataType) -> Column:
    """Text to a typed value; text that cannot be read becomes NULL instead of failing the job."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text).cast("date")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(text.try_cast("boolean"), text.try_cast("double") != 0)
    if isinstance(kind, T.DoubleType):
        return F.when(~F.isnan(text.try_cast("double")), text.try_cast("double"))
    return text.try_cast("double").try_cast(kind)


def read_csv(spark: SparkSession, path: str, position: int = 0) -> DataFrame:
    """One export with a header. Columns are found by name; unlisted ones are left out.

    A file without a key column gets one from its ``position`` among the files and the place of each line.
    It keeps the incoming order and becomes fixed when the prepared table is written.
    """
    text = spark.read.csv(path, header=True, multiLine=False, escape='"')
    key = [] if KEY in text.columns else [
        F.format_string("%05d-%020d", F.lit(position), F.monotonically_increasing_id()).alias(KEY)]
    text = text.select("*", *key)
    return text.select([_parsed(F.col(f.name), f.dataType).alias(f.name) for f in RAW_SCHEMA])


def union_years(years: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), years)


def read_csv_years(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_years([read_csv(spark, p, k) for k, p in enumerate(paths)])


def require_unique_keys(lines: DataFrame) -> None:
    """Fail with an example if a key is missing or repeated: everything that follows a row relies on it."""
    bad = lines.groupBy(KEY).count().where(F.col(KEY).isNull() | (F.col("count") > 1)).first()
    if bad is not None:
        raise ValueError(f"{KEY} {bad[KEY]!r} identifies {bad['count']} rows")


def write_prepared(prepared: DataFrame, path: str) -> None:
    """One folder per year of the order date, so that readers skip the years they do not ask for.

    A source brings its lines together by year while they are narrow, which avoids a small file per task and year; the
    wide rows are not shuffled. The keys are checked once on what was written, reading the key column alone.
    """
    writer = prepared.write.mode("overwrite").option("compression", "zstd").partitionBy("orderYear")
    with compiled(prepared.sparkSession):
        writer.parquet(path)
    require_unique_keys(prepared.sparkSession.read.parquet(path))


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """The prepared table with its types as written."""
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Long metrics (run, day, metric, node, value) as JSON lines."""
    metrics.write.mode(mode).json(path)


METRICS_SCHEMA = "run string, day int, metric string, node string, value double"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)
