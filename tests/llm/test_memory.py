"""The driver gives memory back while an operator runs."""

from ordersight.llm import common


def collections(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_durable_tables_let_the_driver_collect(spark, monkeypatch):
    monkeypatch.setattr(common, "_COLLECTED", {"at": 0.0})
    before = collections(spark)
    assert common.durable(spark.range(5)).count() == 5
    after = collections(spark)
    common.durable(spark.range(5))  # not again within a few seconds
    assert collections(spark) == after > before
