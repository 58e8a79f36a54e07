"""What was known about an order X days after it: flags, product, seller and outcome history.

Histories are computed on tables of one row per key and day, so a popular key costs at most one row
per calendar day in any window, however many order lines it has. All days X share one sort: each X
is only another frame over the same ordering.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.functions.columns import (
    day_number, first_day_at_or_after, holds, natural_log, percent, ratio)
from ordersight.operators.cleaning import group_flags, month_flags, weekday_flags
from ordersight.session import lookup_join, write_scratch, written

MISSING_KEY = "UNKNOWN"
PRODUCT_FIELDS = ["productOrderCount", "productTotalCount", "productTotalReturned",
                  "productReturnFraction"]


def known_flags(days_after: int) -> dict[str, Column]:
    """Determinants known at the day, and the transporter once the parcel is shipped."""
    def by_then(offset: str) -> Column:
        return F.col(offset) <= days_after

    flags = {f"{d}KnownX": by_then(f"{d}Days") for d in ["case", "return", "cancellation"]}
    flags["onTimeDeliveryKnownX"] = by_then("actualDeliveryDays") & F.col("onTimeDelivery")
    flags["lateDeliveryKnownX"] = by_then("actualDeliveryDays") & ~F.col("onTimeDelivery")
    for name in V.TRANSPORTER_X:
        transporter = name.removeprefix("transporter").removesuffix("/X")
        flags[name] = by_then("shipmentDays") & (F.col("transporterCodeGeneral") == transporter)
    return {name: holds(flag) for name, flag in flags.items()}


def with_known_flags(df: DataFrame, days_after: int) -> DataFrame:
    return df.withColumns(known_flags(days_after))


# --- states of several days -----------------------------------------------------------------

def _states(table: DataFrame, name: str, first: Column, state: Column, days: list[int], by_day, since: int,
            delay: int = 0, own: bool = False) -> DataFrame:
    """Adds ``<name>_states``: the different states that the days X see, and for each X which of them.

    ``first`` holds for every X until the key has a row between ``since`` days after the row's own and X - ``delay``;
    then the state of the last such row does. With ``own`` it holds for X <= 0 in any case. A key seldom changes from day to day, so this is far smaller than a state per X.
    """
    last = max(days) - delay
    if last < since:
        later = F.array().cast(f"array<struct<day:int,state:{table.select(state.alias('s')).schema['s'].dataType.simpleString()}>>")
    else:
        later = F.collect_list(F.struct(F.col("day"), state.alias("state"))).over(by_day.rangeBetween(since, last))
    table = table.withColumns({"first": first, "later": later})

    def seen(x: int) -> Column:
        if x - delay < since or own and x <= 0:
            return F.lit(0)
        return F.size(F.filter("later", lambda s: s["day"] <= F.col("day") + x - delay))
    at = F.map_from_arrays(F.array(*map(F.lit, days)), F.array(*map(seen, days)))
    values = F.concat(F.array("first"), F.transform("later", lambda s: s["state"]))
    return table.withColumn(f"{name}_states", F.struct(at.alias("at"), values.alias("values"))).drop("first", "later")


def _state_of(name: str, days_after: int) -> Column:
    states = F.col(f"{name}_states")
    return F.get(states["values"], states["at"][F.lit(days_after)])


# --- products -------------------------------------------------------------------------------

def product_daily(prepared: DataFrame) -> DataFrame:
    """Per product and day: order lines, ordered units, lines with a quantity, units seen returned.

    An order line is up to two events: the order, and the return on the first day whose midnight is
    not before it. Both are summed before the shuffle.
    """
    ordered = F.struct(
        day_number(F.col("orderDate")).alias("day"), F.lit(1).cast("long").alias("lines"),
        F.coalesce("quantityOrdered", F.lit(0.0)).alias("units"),
        F.col("quantityOrdered").isNotNull().cast("long").alias("orders"),
        F.lit(0.0).alias("returned"))
    seen = F.greatest(day_number(F.col("orderDate")), first_day_at_or_after(F.col("returnDateTime")))
    back = F.struct(
        F.when(F.col("quantityReturned").isNotNull() & F.col("returnDateTime").isNotNull(), seen)
        .alias("day"), F.lit(0).cast("long").alias("lines"), F.lit(0.0).alias("units"),
        F.lit(0).cast("long").alias("orders"),
        F.coalesce("quantityReturned", F.lit(0.0)).alias("returned"))
    events = (prepared.where(F.col("productId").isNotNull() & F.col("orderDate").isNotNull())
              .select("productId", F.inline(F.array(ordered, back)))
              .where(F.col("day").isNotNull()))
    return events.groupBy("productId", "day").agg(
        *[F.sum(c).alias(c) for c in ["lines", "units", "orders", "returned"]])


def _product_order_days(prepared: DataFrame) -> DataFrame:
    """(productId, day) of the days with orders, and their ``state``.

    A return is counted from the first later processed line on. The very first line of a product
    therefore never sees one, which matters only if it is alone on its day.
    """
    by_day = Window.partitionBy("productId").orderBy("day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lone_first = (F.row_number().over(by_day) == 1) & (F.col("lines") == 1)
    running = product_daily(prepared).select(
        "productId", "day", "lines",
        F.sum("orders").over(upto).cast("double").alias("productOrderCount"),
        F.sum("units").over(upto).alias("productTotalCount"),
        F.when(lone_first, 0.0).otherwise(F.sum("returned").over(upto)).alias("productTotalReturned"))
    order_days = running.where("lines > 0").select(
        "productId", "day", "productOrderCount", "productTotalCount", "productTotalReturned",
        ratio(F.col("productTotalReturned"), F.col("productTotalCount")).alias("productReturnFraction"))
    state = F.struct(*[F.col(f).alias(f + "X") for f in PRODUCT_FIELDS])
    return order_days.select("productId", "day", state.alias("state"))


def product_states(prepared: DataFrame, days: list[int]) -> DataFrame:
    """(productId, day) with ``product_states`` of the requested days.

    Each X takes the last order day up to X days after the row's own; X <= 0 its own.
    """
    by_day, state = Window.partitionBy("productId").orderBy("day"), F.col("state")
    return _states(_product_order_days(prepared), "product", state, state, days, by_day, 1).select(
        "productId", "day", "product_states")


def product_history(prepared: DataFrame, days: list[int]) -> DataFrame:
    """(productId, day) with one struct ``product_X`` per requested X, of the same states.

    Nothing is joined to them here, so each X is a frame of its own, which costs less than lists of states.
    """
    by_day = Window.partitionBy("productId").orderBy("day")

    def seen(x: int) -> Column:
        return F.last("state").over(by_day.rangeBetween(Window.unboundedPreceding, x)) if x > 0 else F.col("state")
    return _product_order_days(prepared).select("productId", "day", *[seen(x).alias(f"product_{x}") for x in days])


# --- outcome shares -------------------------------------------------------------------------

def _outcome_counts() -> list[Column]:
    return [F.count_if(F.col(V.OUTCOME) == k.upper()).alias(k) for k in KINDS]


KINDS = ["Happy", "Unhappy", "Unknown"]


def _outcome_states(daily: DataFrame, variable: str, days: list[int], by_day) -> DataFrame:
    """Adds the shares of the outcomes final by each prediction day; final is 30 days after the order."""
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The counts come first: inside the shares each would be a window expression several times over.
    counted = daily.withColumns({k: F.sum(k).over(upto) for k in KINDS})

    def shares(n: dict[str, Column]) -> Column:
        total = n["Happy"] + n["Unhappy"] + n["Unknown"]
        return F.struct(*[percent(n[k], total).alias(f"{variable}Historic{k}X") for k in KINDS])
    counted = counted.withColumn("shares", shares({k: F.col(k) for k in KINDS})).drop(*KINDS)
    start = min(days) - V.OUTCOME_DELAY
    first = F.coalesce(F.last("shares").over(by_day.rangeBetween(Window.unboundedPreceding, start)),
                       shares(dict.fromkeys(KINDS, F.lit(0))))
    return _states(counted, variable, first, F.col("shares"), days, by_day, start + 1, V.OUTCOME_DELAY).drop("shares")


def key_of(variable: str) -> Column:
    """Grouping key of a history variable; missing keys form a group of their own."""
    return F.coalesce(F.col(variable).cast("string"), F.lit(MISSING_KEY))


def outcome_states(prepared: DataFrame, variable: str, days: list[int]) -> DataFrame:
    """(key, day) with ``<variable>_states``, the outcome shares of the requested days."""
    by_day = Window.partitionBy("key").orderBy("day")
    daily = (prepared.where(F.col("orderDate").isNotNull())
             .groupBy(key_of(variable).alias("key"), day_number(F.col("orderDate")).alias("day"))
             .agg(*_outcome_counts()))
    return _outcome_states(daily, variable, days, by_day)


def outcome_history(prepared: DataFrame, variable: str, days: list[int]) -> DataFrame:
    """(key, day) with one struct ``<variable>_X`` of outcome shares per requested X."""
    return outcome_states(prepared, variable, days).select(
        "key", "day", *[_state_of(variable, x).alias(f"{variable}_{x}") for x in days])


# --- sellers --------------------------------------------------------------------------------

def seller_states(prepared: DataFrame, days: list[int], outcomes: bool = True) -> DataFrame:
    """(key, day) with ``seller_states`` (log of orders per day since the first) and ``sellerId_states``, outcome shares.

    Both histories need the rows by seller, so they share one aggregation and one sort.
    """
    by_day = Window.partitionBy("key").orderBy("day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.col("sellerId").isNotNull()
    daily = (prepared.where(F.col("orderDate").isNotNull())
             .groupBy(key_of("sellerId").alias("key"), day_number(F.col("orderDate")).alias("day"))
             .agg(F.count_if(named).alias("lines"),
                  F.count(F.when(named, F.col("quantityOrdered"))).alias("orders"),
                  *(_outcome_counts() if outcomes else [])))
    first = F.min(F.when(F.col("lines") > 0, F.col("day"))).over(upto)
    rate = natural_log(F.sum("orders").over(upto) / (F.col("day") - first + 1))
    rated = daily.withColumn("rate", F.when(F.col("lines") > 0, rate)).drop("lines", "orders")
    # An X > 0 takes the last rate there is up to that day.
    rated = rated.withColumn("known", F.last("rate", ignorenulls=True).over(upto))
    rated = _states(rated, "seller", F.col("rate"), F.col("known"), days, by_day, 0, own=True)
    rated = rated.drop("rate", "known")
    return _outcome_states(rated, "sellerId", days, by_day) if outcomes else rated


def seller_history(prepared: DataFrame, days: list[int], outcomes: bool = True) -> DataFrame:
    """(key, day) with ``seller_X`` and, unless left out, one struct of outcome shares per requested X."""
    shares = [_state_of("sellerId", x).alias(f"sellerId_{x}") for x in days] if outcomes else []
    return seller_states(prepared, days, outcomes).select(
        "key", "day", *[_state_of("seller", x).alias(f"seller_{x}") for x in days], *shares)


# --- feature matrix -------------------------------------------------------------------------

def _attach(rows: DataFrame, history: DataFrame, key: Column, small: bool = False) -> DataFrame:
    """Join a history table back to the rows on (key, day); the day spreads a hot key over tasks."""
    keyed = rows.withColumns({"key": key, "day": day_number(F.col("orderDate"))})
    name = history.columns[0]
    history = history.withColumnRenamed(name, "key") if name != "key" else history
    if small:
        out = lookup_join(keyed, history, ["key", "day"], "history")
    else:
        out = keyed.join(history, ["key", "day"], "left")
    return out.drop("key", "day")


# One-hot columns follow from three codes. The codes travel through the shuffles, the flags do not.
CARRIED = V.BASIC + V.YEAR + ["orderWeekday", "orderMonth", "productGroupGeneral"]
FLAG_SOURCES = ["caseDays", "returnDays", "cancellationDays", "actualDeliveryDays", "onTimeDelivery",
                "shipmentDays", "transporterCodeGeneral"]


#: The columns of the prepared table that each history, and all of a matrix, are made from.
PRODUCT_COLUMNS = ["productId", V.DATE, "quantityOrdered", "quantityReturned", "returnDateTime"]
SELLER_COLUMNS = ["sellerId", V.DATE, "quantityOrdered"]
MATRIX_COLUMNS = list(dict.fromkeys([V.KEY, V.DATE, V.LABEL, V.OUTCOME, *CARRIED, *FLAG_SOURCES, *PRODUCT_COLUMNS,
                                     *SELLER_COLUMNS, *V.HISTORY_VARIABLES]))


def _histories(prepared: DataFrame, days: list[int]) -> dict[str, DataFrame]:
    """The tables of states that the lines meet, by the name of their key."""
    found = {"productId": product_states(prepared, days), "sellerId": seller_states(prepared, days)}
    return found | {v: outcome_states(prepared, v, days) for v in SMALL_HISTORIES}


#: Their tables are usually broadcast, so they come last: no shuffle carries their shares.
SMALL_HISTORIES = ["transporterCode", "productGroup"]


def _base(prepared: DataFrame, histories: dict[str, DataFrame]) -> DataFrame:
    rows = prepared.select(V.KEY, V.DATE, V.LABEL, *CARRIED, *FLAG_SOURCES,
                           "productId", *V.HISTORY_VARIABLES)
    for c in [V.KEY, V.DATE, V.LABEL, *V.BASIC, *V.YEAR, "productId", "sellerId"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = _attach(rows, histories["productId"], F.col("productId"))
    rows = _attach(rows, histories["sellerId"], key_of("sellerId"))
    for v in SMALL_HISTORIES:
        rows = _attach(rows, histories[v], key_of(v), small=True)
    return rows


def feature_base(prepared: DataFrame, days: list[int]) -> DataFrame:
    """The order lines that can be complete on some day, with what all requested days need.

    The rows are shuffled once for all X. Lines without product, seller, label or another feature that
    does not depend on the day are left out before the shuffles; the histories still see them.
    """
    return _base(prepared, _histories(prepared, days))


#: Lines whose shuffles lie on disk at the same time while a base is written.
LINES_AT_ONCE = 12_000_000


def written_base(prepared: DataFrame, days: list[int], at_once: int | None = None) -> DataFrame:
    """The same rows, written. Histories are written first; then the lines meet them in turns of some order days each, about
    ``at_once`` lines a turn, so that the shuffles on disk are those of one turn whatever the number of lines."""
    spark, name = prepared.sparkSession, "base"
    turns = max(1, -(-prepared.count() // (at_once or LINES_AT_ONCE)))
    if turns == 1:
        return written(feature_base(prepared, days), name)
    histories = {v: written(t, "states") for v, t in _histories(prepared, days).items()}
    paths, schema = [], None
    for turn in range(turns):
        def own(table: DataFrame, day: Column, turn=turn) -> DataFrame:
            return table.where(F.pmod(F.xxhash64(day), F.lit(turns)) == turn)
        # Lines without a date are in no base.
        rows = _base(own(prepared, day_number(F.col(V.DATE))), {v: own(t, F.col("day")) for v, t in histories.items()})
        paths, schema = [*paths, write_scratch(rows, name)], rows.schema
    return spark.read.schema(schema).parquet(*paths)


def _static_columns() -> list[Column]:
    flags = (weekday_flags(F.col("orderWeekday")) | month_flags(F.col("orderMonth"))
             | group_flags(F.col("productGroupGeneral")))
    return [flags[f].alias(f) if f in flags else F.col(f) for f in V.STATIC_FEATURES]


def _day_states(days_after: int) -> list[Column]:
    """Known flags and the states of a day; each state is looked up once."""
    flags = [flag.alias(name) for name, flag in known_flags(days_after).items()]
    return flags + [_state_of(name, days_after).alias(f"{name}_state") for name in ["product", "seller", *V.HISTORY_VARIABLES]]


def _day_columns() -> list[Column]:
    """The features of a day, from its flags and states."""
    fields = {f: F.col("product_state")[f] for f in V.PRODUCT_X} | {"sellerDailyOrdersX": F.col("seller_state")}
    for v in V.HISTORY_VARIABLES:
        fields |= {f: F.col(f"{v}_state")[f] for f in V.HISTORY_X if f.startswith(v)}
    return [fields.get(f, F.col(f"`{f}`")).alias(f) for f in V.FEATURES if f not in V.STATIC_FEATURES]


def matrix_of_day(base: DataFrame, days_after: int, carried: tuple[str, ...] = (), finite: bool = True) -> DataFrame:
    """Key, date, 69 features and label of one day; lines with any of them missing are left out.

    Columns named in ``carried`` go along as they are. Models take finite values alone; without ``finite`` the logarithm
    of a zero price stays.
    """
    of_day = base.select(V.KEY, V.DATE, *_static_columns(), *_day_states(days_after), V.LABEL, *carried)
    return complete_rows(of_day.select(V.KEY, V.DATE, *[F.col(f"`{f}`") for f in V.STATIC_FEATURES], *_day_columns(),
                                       V.LABEL, *carried), carried, finite)


def complete_rows(df: DataFrame, but: tuple[str, ...] = (), finite: bool = True) -> DataFrame:
    """Rows without NULL or NaN outside ``but``, and with ``finite`` without infinity: the logarithm of a zero price is
    infinite, and no model can take it. One condition per column: a single one over all columns, as na.drop builds it, makes the optimizer derive a
    variant for every combination of later aliases."""
    conditions = []
    for f in df.schema:
        if f.name in but:
            continue
        c = F.col(f"`{f.name}`")
        # NaN is greater than any number, so that the comparison holds for finite values alone.
        real = f.dataType.typeName() in ("double", "float")
        number = F.abs(c) < float("inf") if finite else ~F.isnan(c) & c.isNotNull()
        conditions.append(number if real else c.isNotNull())
    return df.where(reduce(and_, conditions))


def feature_matrix(prepared: DataFrame, days_after: int) -> DataFrame:
    return matrix_of_day(feature_base(prepared, [days_after]), days_after, finite=False)


def feature_matrix_all_days(prepared: DataFrame, days: list[int]) -> DataFrame:
    """The matrices of several days, stacked, with the day as a column; built from one base."""
    return matrices_of_days(feature_base(prepared, days), days, finite=False)


def matrices_of_days(base: DataFrame, days: list[int], finite: bool = True) -> DataFrame:
    """The same from a base that is already there: one pass over its rows for all days."""
    per_day = F.array(*[F.struct(F.lit(x).alias("day"), *_day_states(x)) for x in days])
    columns = {c: F.col(f"`{c}`") for c in V.STATIC_FEATURES}
    stacked = base.select(V.KEY, V.DATE, *_static_columns(), V.LABEL, F.inline(per_day)).select(
        V.KEY, "day", V.DATE, *columns.values(), *_day_columns(), V.LABEL)
    return complete_rows(stacked.select(V.KEY, "day", V.DATE, *[F.col(f"`{f}`") for f in V.FEATURES], V.LABEL), finite=finite)
