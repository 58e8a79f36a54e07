import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ordersight.functions import values as V
from ordersight.operators import cleaning as C
from ordersight.plans.prepare import clean, typed
from ordersight.sources import orders as O


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_swapped_labels_and_prefix(raw):
    r = one(C.rename_recode(raw({"generalMatchClassification": "KNOWN MEDIUM UNHAPPY",
                                 "detailedMatchClassification": "UNHAPPY"})))
    assert (r["generalMatchClassification"], r["detailedMatchClassification"]) == ("UNHAPPY", "MEDIUM UNHAPPY")


def test_missing_flag_is_true(raw):
    assert one(typed(raw({"noReturn": None})))["noReturn"] is True


@pytest.mark.parametrize("price, log", [(0.0, -math.inf), (-1.0, None), (math.e, 1.0)])
def test_log_of_price(raw, price, log):
    got = one(clean(raw({"totalPrice": price})))["totalPrice"]
    assert got == log if log is None or math.isinf(log) else got == pytest.approx(log)


@pytest.mark.parametrize("change, noise", [
    ({}, False),
    ({"startDateCase": dt.date(2020, 3, 1)}, True),
    ({"registrationDateSeller": None}, True),
    ({"promisedDeliveryDate": None}, True),
    ({"datetTimeFirstDeliveryMoment": dt.datetime(2020, 3, 2, 1)}, False),
    ({"returnDateTime": dt.datetime(2020, 3, 4, 9), "datetTimeFirstDeliveryMoment": dt.datetime(2020, 3, 4, 14)}, False),
    ({"returnDateTime": dt.datetime(2020, 3, 3, 9), "datetTimeFirstDeliveryMoment": dt.datetime(2020, 3, 4, 14)}, True),
    ({"cancellationDate": dt.date(2020, 3, 9), "returnDateTime": dt.datetime(2020, 3, 8)}, True),
])
def test_noise(raw, change, noise):
    assert C.remove_noise(typed(raw(change))).count() == (0 if noise else 1)


def test_repairs_see_the_unrepaired_row(raw):
    r = one(C.repair(typed(raw({
        "returnDateTime": dt.datetime(2020, 3, 9), "quanityReturned": 3.0, "returnCode": "R",
        "cancellationDate": dt.date(2020, 3, 3), "cancellationReasonCode": "C", "onTimeDelivery": None,
        "datetTimeFirstDeliveryMoment": dt.datetime(2020, 3, 5)}))))
    assert r["returnDateTime"] is None and r["returnCode"] is None
    assert r["quantityReturned"] == 1.0  # emptied by one rule, then set by the quantity rule
    assert r["cancellationDate"] is None and r["dateTimeFirstDeliveryMoment"] is None


@pytest.mark.parametrize("flags, name", [
    ((True, True, True, True), "All good"), ((True, True, True, None), "Unknown delivery"),
    ((True, False, False, False), "Return + Case + Late delivery"), ((True, True, False, None), "Case + Unknown delivery"),
    ((False, True, True, True), "Cancellation")])
def test_determinants(raw, flags, name):
    change = dict(zip(["noCancellation", "noReturn", "noCase", "onTimeDelivery"], flags))
    assert one(clean(raw(change)))["determinantClassification"] == name


def test_groups_and_missing_codes(raw):
    r = one(clean(raw({"transporterCode": None, "productGroup": "no such group"})))
    assert (r["transporterCodeGeneral"], r["productGroupGeneral"]) == ("OTHER", "Other")
    assert r["groupOther"] and not r["groupHome"]
    assert all(c in r.asDict() for c in V.GROUP)


def test_calendar(raw):
    r = one(clean(raw({"orderDate": dt.date(2020, 3, 20)})))
    assert not r["orderCorona"] and r["orderFriday"] and r["orderMarch"] and r["orderYear2020"]
    assert one(clean(raw({"orderDate": dt.date(2020, 3, 21)})))["orderCorona"]


def test_availability_skips_missing_offsets(raw):
    prepared = clean(raw({"startDateCase": dt.date(2020, 3, 2), "noCase": False},
                         {"startDateCase": dt.date(2020, 3, 5), "noCase": False}, {}))
    got = {r["day"]: r for r in C.determinant_availability(prepared).collect()}
    assert got[0]["caseDays_share"] == 0.5 and got[3]["caseDays_share"] == 1.0
    assert got[0]["promisedDeliveryDays_n"] is None


def test_csv_years_and_prepared_table(spark, raw, tmp_path):
    lines = raw({"totalPrice": 5.0}, {"returnDateTime": dt.datetime(2020, 3, 9, 9), "noReturn": False})
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    lines.limit(1).write.csv(a, header=True)
    lines.select(*reversed(lines.columns)).drop("orderLineId").withColumn("noReturn", F.lit("x")).write.csv(b, header=True)
    back = O.read_csv_years(spark, [a, b])
    assert back.count() == 3 and back.select("orderLineId").distinct().count() == 3
    assert back.where("noReturn IS NULL").count() == 2  # text that is no flag
    out = str(tmp_path / "out")
    O.write_prepared(clean(lines), out)
    assert O.read_prepared(spark, out).where("orderYear = 2020").count() == 2


def test_keyless_exports_get_different_keys(spark, raw, tmp_path):
    paths = [str(tmp_path / name) for name in ("a", "b")]
    for p in paths:
        raw(*[{"totalPrice": float(k)} for k in range(5)]).drop("orderLineId").coalesce(1).write.csv(p, header=True)
    back = O.read_csv_years(spark, paths)
    assert back.count() == 10 and back.select("orderLineId").distinct().count() == 10


def test_repeated_keys_fail_when_written(raw, tmp_path):
    lines = raw({"orderLineId": "k"}, {"orderLineId": "k"}, {"orderLineId": "m"})
    with pytest.raises(ValueError, match="'k' identifies 2 rows"):
        O.write_prepared(clean(lines), str(tmp_path / "out"))


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from ordersight.session import shared_folder
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
