import datetime as dt
import random

import pytest

from ordersight.operators import splits as S


def table(spark, n, hot=0.5, seed=1):
    rng = random.Random(seed)
    rows = [(f"{rng.randrange(50)}-{i}", dt.date(2020, 1, 1) + dt.timedelta(days=3 if rng.random() < hot else rng.randrange(7)))
            for i in range(n)]
    return spark.createDataFrame(rows, "orderLineId string, orderDate date"), sorted(rows, key=lambda r: (r[1], r[0].encode()))


@pytest.mark.parametrize("sortable", [1, 7, 100_000])
def test_split_equals_a_full_sort(spark, sortable):
    df, ordered = table(spark, 501)
    got = {r["orderLineId"]: r["split"] for r in S.temporal_split(df, sortable=sortable).collect()}
    end = int(0.8 * 501)
    start = int(0.1 * end)
    for i, (key, _) in enumerate(ordered):
        assert got[key] == ("burn_in" if i < start else "train" if i < end else "test")


def test_validation_split_sizes(spark):
    df, _ = table(spark, 333)
    n = {r["split"]: r["count"] for r in S.validation_split(df, sortable=5).groupBy("split").count().collect()}
    assert n == {"burn_in": 33, "train": 240, "validation": 60}


def test_sample_is_exact_and_repeatable(spark):
    df, ordered = table(spark, 400)
    first = {r["orderLineId"] for r in S.seeded_sample(df, 100, 1).collect()}
    again = {r["orderLineId"] for r in S.seeded_sample(df.repartition(3), 100, 1, sortable=3).collect()}
    other = {r["orderLineId"] for r in S.seeded_sample(df, 100, 2).collect()}
    assert len(first) == 100 and first == again and first != other
    assert first <= {k for k, _ in ordered[:320]}
    with pytest.raises(ValueError):
        S.seeded_sample(df, 321)
