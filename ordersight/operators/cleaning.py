"""Cleaning of raw order lines: names and labels, noise, repairs, derived columns. No shuffle."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.functions.columns import (
    day_gap, grouped, holds, missing_is_true, natural_log, same)
from ordersight.sources.orders import FLAGS

RENAMED = {
    "datetTimeFirstDeliveryMoment": "dateTimeFirstDeliveryMoment",
    "quanityReturned": "quantityReturned",
    "generalMatchClassification": "detailedMatchClassification",
    "detailedMatchClassification": "generalMatchClassification",
}


@dataclass(frozen=True)
class CalendarFlags:
    """The two calendar parameters: orderCorona is strictly after a date, orderYear2020 is one year."""

    after: datetime.date = datetime.date(2020, 3, 20)
    year: int = 2020


def rename_recode(raw: DataFrame) -> DataFrame:
    """Correct the column names (two labels arrive swapped) and drop the prefix of the known labels."""
    def without_prefix(name: str, labels: list[str]) -> Column:
        return F.when(F.col(name).isin([V.KNOWN_PREFIX + x for x in labels]),
                      F.substring(F.col(name), len(V.KNOWN_PREFIX) + 1, 100)).otherwise(F.col(name))

    recoded = {V.OUTCOME: V.RECODED_GENERAL, V.LABEL: V.RECODED_DETAILED}
    out = []
    for name in raw.columns:
        new = RENAMED.get(name, name)
        value = without_prefix(name, recoded[new]) if new in recoded else F.col(name)
        out.append(value.alias(new))
    return raw.select(out)


def cast_flags(df: DataFrame) -> DataFrame:
    return df.select([missing_is_true(F.col(c)).alias(c) if c in FLAGS else F.col(c)
                      for c in df.columns])


def noise_rules() -> dict[str, Column]:
    """The rules by which an order line is nonsensical; none is ever NULL."""
    order, case, cancel = F.col("orderDate"), F.col("startDateCase"), F.col("cancellationDate")
    promise, ship, back = F.col("promisedDeliveryDate"), F.col("shipmentDate"), F.col("returnDateTime")
    delivery_day = F.col("dateTimeFirstDeliveryMoment").cast("date")
    registered = F.col("registrationDateSeller")
    rules = {
        "case_before_order": case < order,
        "cancellation_before_order": cancel < order,
        "promise_before_order": promise < order,
        "shipment_before_order": ship < order,
        "return_before_order": back < order,
        "cancellation_after_return": cancel > back,
        "order_before_registration": order < registered,
        "order_after_delivery": order > delivery_day,
        "cancellation_after_delivery": cancel > delivery_day,
        "return_before_delivery": back < delivery_day,
        "no_registration": registered.isNull(),
        "no_promise": promise.isNull(),
    }
    return {name: holds(rule) for name, rule in rules.items()}


def is_noise() -> Column:
    return reduce(or_, noise_rules().values())


def remove_noise(df: DataFrame) -> DataFrame:
    return df.where(~is_noise())


def repair_rules() -> dict[str, Column]:
    return {
        "cancellation": F.col("noCancellation") & F.col("cancellationDate").isNotNull(),
        "return": F.col("noReturn") & F.col("returnDateTime").isNotNull(),
        "case": F.col("noCase") & F.col("startDateCase").isNotNull(),
        "quantity": holds(F.col("quantityReturned") > F.col("quantityOrdered")),
        "delivery": F.col("dateTimeFirstDeliveryMoment").isNotNull() & F.col("onTimeDelivery").isNull(),
    }


EMPTIED = {
    "cancellation": ["cancellationDate", "cancellationReasonCode"],
    "return": ["returnDateTime", "quantityReturned", "returnCode"],
    "case": ["startDateCase", "cntDistinctCaseIds", "hasOneCase", "hasMoreCases"],
    "delivery": ["dateTimeFirstDeliveryMoment"],
}


def repair(df: DataFrame) -> DataFrame:
    """Empty details that contradict their flag and cap the returned quantity.

    One select, so every rule sees the unrepaired row. A capped quantity wins over an emptied one,
    because it is assigned last.
    """
    rules = repair_rules()
    new = {c: F.when(~rules[rule], F.col(c)) for rule, cols in EMPTIED.items() for c in cols}
    new["quantityReturned"] = F.when(rules["quantity"], F.col("quantityOrdered")).otherwise(
        new["quantityReturned"])
    return df.select([new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def with_price(df: DataFrame) -> DataFrame:
    return df.withColumn("totalPrice", natural_log(F.col("totalPrice")))


OFFSETS = {
    "caseDays": ("startDateCase", "orderDate"),
    "returnDays": ("returnDateTime", "orderDate"),
    "cancellationDays": ("cancellationDate", "orderDate"),
    "actualDeliveryDays": ("dateTimeFirstDeliveryMoment", "orderDate"),
    "shipmentDays": ("shipmentDate", "orderDate"),
    "partnerSellingDays": ("orderDate", "registrationDateSeller"),
    "promisedDeliveryDays": ("promisedDeliveryDate", "orderDate"),
}


def with_offsets(df: DataFrame) -> DataFrame:
    return df.withColumns({n: day_gap(F.col(a), F.col(b)) for n, (a, b) in OFFSETS.items()})


def weekday_flags(weekday: Column) -> dict[str, Column]:
    return {f"order{n}": same(weekday, F.lit(i)) for i, n in enumerate(V.WEEKDAYS)}


def month_flags(month: Column) -> dict[str, Column]:
    return {f"order{n}": same(month, F.lit(i + 1)) for i, n in enumerate(V.MONTHS)}


def group_flags(group: Column) -> dict[str, Column]:
    """A fixed list of one-hot columns; absent groups are all False."""
    return {V.group_column(g): same(group, F.lit(g)) for g in [*V.PRODUCT_GROUPS, V.OTHER_GROUP]}


def with_calendar(df: DataFrame, flags: CalendarFlags = CalendarFlags()) -> DataFrame:
    """Year, month and weekday (0 = Monday) of the order, with their one-hot flags."""
    date = F.col("orderDate")
    parts = {"orderYear": F.year(date), "orderMonth": F.month(date), "orderWeekday": F.weekday(date)}
    one_hot = weekday_flags(parts["orderWeekday"]) | month_flags(parts["orderMonth"])
    return df.withColumns(parts | one_hot | {
        "orderCorona": holds(date > F.lit(flags.after)),
        "orderYear2020": same(parts["orderYear"], F.lit(flags.year)),
    })


def with_order_flags(df: DataFrame) -> DataFrame:
    origin = F.col("countryOriginSeller")
    return df.withColumns({
        "productTitleLength": F.char_length("productTitle"),
        "fulfilmentByPlatform": same(F.col("fulfilmentType"), F.lit("FBB")),
        "countryCodeNL": same(F.col("countryCode"), F.lit("NL")),
        **{f"countryOrigin{c}": same(origin, F.lit(c)) for c in ["NL", "BE", "DE"]},
    })


def determinant_class() -> Column:
    """What went wrong with the order, from its three flags and the three-state delivery."""
    late = F.when(F.col("onTimeDelivery").isNull(), "Unknown delivery").when(
        ~F.col("onTimeDelivery"), "Late delivery")
    problems = F.concat_ws(" + ", F.when(~F.col("noReturn"), "Return"),
                           F.when(~F.col("noCase"), "Case"), late)
    return (F.when(~F.col("noCancellation"), "Cancellation")
            .when(problems == "", "All good").otherwise(problems))


def binary_class() -> Column:
    return F.when(same(F.col(V.OUTCOME), F.lit("UNKNOWN")), "UNKNOWN").otherwise("KNOWN")


def with_classes(df: DataFrame) -> DataFrame:
    return df.withColumns({"determinantClassification": determinant_class(),
                           "binaryMatchClassification": binary_class()})


def with_transporter(df: DataFrame) -> DataFrame:
    return df.withColumn("transporterCodeGeneral", grouped(
        F.col("transporterCode"), V.TRANSPORTERS, V.OTHER_TRANSPORTER))


def with_product_group(df: DataFrame) -> DataFrame:
    """General product group and its one-hot columns."""
    df = df.withColumn("productGroupGeneral", grouped(
        F.col("productGroup"), V.PRODUCT_GROUPS, V.OTHER_GROUP))
    return df.withColumns(group_flags(F.col("productGroupGeneral")))


# --- reports --------------------------------------------------------------------------------

def _long_counts(df: DataFrame, rules: dict[str, Column], name: str) -> DataFrame:
    """One pass over the rows: how many satisfy each rule, one output row per rule."""
    counts = df.agg(*[F.count_if(rule).alias(rule_name) for rule_name, rule in rules.items()])
    return counts.unpivot([], list(rules), name, "n")


def noise_by_rule(typed: DataFrame) -> DataFrame:
    return _long_counts(typed, noise_rules() | {"any": is_noise()}, "rule")


def cleaning_report(typed: DataFrame) -> DataFrame:
    """Records read, removed and kept, and kept records touched by each repair."""
    kept = ~is_noise()
    rules = {"records": F.lit(True), "removed": is_noise(), "kept": kept}
    rules |= {f"repaired_{name}": kept & rule for name, rule in repair_rules().items()}
    return _long_counts(typed, rules, "item")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value, missing values included, for several columns in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


AVAILABILITY = ["caseDays", "returnDays", "cancellationDays", "promisedDeliveryDays",
                "actualDeliveryDays"]


def determinant_availability(prepared: DataFrame) -> DataFrame:
    """Per day offset: rows whose determinant becomes known then, and the cumulative share.

    The share is taken of all non-missing values, for deliveries of all rows. An offset without rows
    for a determinant stays NULL there.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("day")) for m in AVAILABILITY])
    # NULL days are counted too: they belong to the denominator of the deliveries.
    per_day = prepared.select(F.inline(pairs)).groupBy("metric", "day").agg(F.count("*").alias("n"))
    metric = Window.partitionBy("metric")
    present = F.col("day").isNotNull()
    total = F.sum(F.when(present | (F.col("metric") == "actualDeliveryDays"), F.col("n"))).over(metric)
    running = F.sum(F.when(present, F.col("n"))).over(metric.orderBy(F.col("day").asc_nulls_first()))
    shares = per_day.select("metric", "day", "n", (running / total).alias("share")).where(present)
    return shares.groupBy("day").pivot("metric", AVAILABILITY).agg(
        F.first("n").alias("n"), F.first("share").alias("share"))
