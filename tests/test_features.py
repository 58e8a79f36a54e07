import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.operators import features as X
from ordersight.plans.prepare import clean

START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def moment(n, hour=0):
    return dt.datetime.combine(day(n), dt.time(hour))


def lines_table(spark, lines):
    """(product, order day, ordered, returned, return moment) in the order of processing."""
    rows = [(f"o{i:05d}", p, day(d), q, r, m) for i, (p, d, q, r, m) in enumerate(lines)]
    return spark.createDataFrame(rows, "orderLineId string, productId long, orderDate date, quantityOrdered double,"
                                       "quantityReturned double, returnDateTime timestamp")


def returned(spark, lines):
    out = X.product_history(lines_table(spark, lines), [0])
    rows = out.select("productId", F.date_from_unix_date("day").alias("d"), "product_0.*").collect()
    return {(r["productId"], (r["d"] - START).days): r["productTotalReturnedX"] for r in rows}


def walked(lines):
    """Line by line: pending returns become known at the next line of the product dated at or after them."""
    out, pending, total, last = {}, [], {}, None
    for p, d, q, r, m in sorted(lines, key=lambda x: (x[0], x[1])):
        first = p != last
        pending, last = ([] if first else pending), p
        if r is not None and m is not None:
            pending.append((m, r))
        if first:
            total[p] = 0.0
        else:
            total[p] += sum(x for t, x in pending if t <= moment(d))
            pending = [(t, x) for t, x in pending if t > moment(d)]
        out[p, d] = total[p]
    return out


def test_same_day_return_of_a_lone_first_line(spark):
    assert returned(spark, [(1, 0, 1.0, 1.0, moment(0)), (1, 4, 1.0, None, None)]) == {(1, 0): 0.0, (1, 4): 1.0}


def test_same_day_return_with_two_first_lines(spark):
    lines = [(1, 0, 1.0, 1.0, moment(0)), (1, 0, 1.0, None, None), (1, 4, 1.0, None, None)]
    assert returned(spark, lines) == {(1, 0): 1.0, (1, 4): 1.0}


def test_return_in_the_morning_counts_from_the_next_day(spark):
    lines = [(1, 0, 1.0, 1.0, moment(2, 9)), (1, 2, 1.0, None, None), (1, 3, 1.0, None, None)]
    assert returned(spark, lines) == {(1, 0): 0.0, (1, 2): 0.0, (1, 3): 1.0}


def test_return_without_moment_never_counts(spark):
    assert returned(spark, [(1, 0, 1.0, 1.0, None), (1, 9, 1.0, None, None)])[1, 9] == 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_returns_match_the_walk_over_lines(spark, seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(400):
        d = rng.randrange(12)
        back = rng.random() < 0.5
        lines.append((1 if rng.random() < 0.4 else rng.randrange(2, 60), d, float(rng.randrange(1, 4)),
                      float(rng.randrange(1, 3)) if back else None,
                      moment(d + rng.randrange(4), rng.choice([0, 9])) if back else None))
    assert returned(spark, lines) == walked(lines)


def test_as_of_is_the_last_order_day(spark):
    rng = random.Random(5)
    lines = [(p, rng.randrange(40), 1.0, None, None) for p in range(5) for _ in range(12)]
    out = X.product_history(lines_table(spark, lines), [0, 1, 5, 10]).collect()
    own = {(r["productId"], r["day"]): r["product_0"]["productTotalCountX"] for r in out}
    days = {p: sorted(d for q, d in own if q == p) for p in range(5)}
    for r in out:
        for x in (1, 5, 10):
            at = days[r["productId"]][bisect.bisect_right(days[r["productId"]], r["day"] + x) - 1]
            assert r[f"product_{x}"]["productTotalCountX"] == own[r["productId"], at]


def outcomes(spark, entries):
    return spark.createDataFrame([(day(d), k, o) for d, k, o in entries],
                                 "orderDate date, transporterCode string, generalMatchClassification string")


def test_outcome_counts_after_exactly_thirty_days(spark):
    df = outcomes(spark, [(0, "A", "HAPPY"), (30, "A", "UNKNOWN"), (29, None, "HAPPY")])
    table = X.outcome_history(df, "transporterCode", [0, 1]).withColumn("date", F.date_from_unix_date("day"))
    got = {(r["key"], x): r[f"transporterCode_{x}"]["transporterCodeHistoricHappyX"]
           for r in table.where(F.col("date") != F.lit(day(0))).collect() for x in (0, 1)}
    assert got == {("A", 0): 100.0, ("A", 1): 100.0, ("UNKNOWN", 0): 0.0, ("UNKNOWN", 1): 0.0}


def test_share_rounds_half_to_even(spark):
    df = outcomes(spark, [(0, "A", "HAPPY")] + [(0, "A", "UNHAPPY")] * 799 + [(40, "A", "HAPPY")])
    row = X.outcome_history(df, "transporterCode", [0]).orderBy(F.desc("day")).first()
    assert row["transporterCode_0"]["transporterCodeHistoricHappyX"] == 0.12


def test_known_flags_grow_with_the_day(raw):
    prepared = clean(raw({"startDateCase": dt.date(2020, 3, 4), "noCase": False, "shipmentDate": dt.date(2020, 3, 5),
                          "datetTimeFirstDeliveryMoment": dt.datetime(2020, 3, 6, 9), "onTimeDelivery": False}))
    rows = [prepared.select(*[v.alias(k) for k, v in X.known_flags(x).items()]).first() for x in (0, 2, 3, 4)]
    assert [r["caseKnownX"] for r in rows] == [False, True, True, True]
    assert [r["transporterPOSTNL/X"] for r in rows] == [False, False, True, True]
    assert [r["lateDeliveryKnownX"] for r in rows] == [False, False, False, True]
    assert not any(r["onTimeDeliveryKnownX"] for r in rows)


def test_matrix_drops_rows_with_missing_features(raw):
    prepared = clean(raw({}, {"productId": None}, {"sellerId": None}, {"totalPrice": -1.0}, {"totalPrice": 0.0}))
    matrix = X.feature_matrix(prepared, 3)
    assert {r["orderLineId"] for r in matrix.collect()} == {"o0000", "o0004"}
    assert matrix.columns == [V.KEY, V.DATE, *V.FEATURES, V.LABEL] and len(V.FEATURES) == 69


def test_stacked_matrix_equals_single_days(raw):
    prepared = clean(raw(*[{"orderDate": dt.date(2020, 3, 1 + i % 9), "productId": i % 3} for i in range(30)]))
    stacked = X.feature_matrix_all_days(prepared, [0, 4])
    for x in (0, 4):
        assert stacked.where(F.col("day") == x).drop("day").exceptAll(X.feature_matrix(prepared, x)).count() == 0


def test_join_beyond_the_broadcast_limit(spark):
    from ordersight.session import lookup_join
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, day int")
    table = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], "key string, day int, share double")
    small = lookup_join(rows, table, ["key", "day"], "t")
    large = lookup_join(rows, table, ["key", "day"], "t", limit_bytes=0)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str) and small.count() == 3
    assert "hint" not in large._jdf.queryExecution().logical().toString().lower()


def test_states_are_kept_once_however_many_days_share_them(raw):
    prepared = clean(raw({}, {"productId": 2}, {"orderDate": day(30)}))
    base = X.feature_base(prepared, list(range(11)))
    for r in base.collect():
        assert len(r["product_states"]["values"]) <= 2 and sorted(r["product_states"]["at"]) == list(range(11))
