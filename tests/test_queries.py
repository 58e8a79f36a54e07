"""Queries next to their SQL on the smallest shared tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from ordersight import session
from ordersight.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
# The queries of the llm package are tested in its own folder.
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no shared tables here")
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    from tools.check import normal
    got, want = entry.queries()[name](spark, str(FOLDER)).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_searches_are_whole(monkeypatch):
    """The registered searches leave days, combinations, trials and the sample to the library; the parts take all rows."""
    import inspect

    from ordersight.functions import values as V
    from ordersight.plans import catalog
    asked = {}
    for name in ("tree_search", "flat_search"):
        whole = inspect.signature(getattr(catalog.SE, name))

        def seen(*args, whole=whole, name=name, **kwargs):
            bound = whole.bind(*args, **kwargs)
            bound.apply_defaults()
            asked[name] = bound.arguments
        monkeypatch.setattr(catalog.SE, name, seen)
    monkeypatch.setattr(catalog, "_prepared", lambda spark, folder: "all lines")
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: None)
    monkeypatch.setattr(catalog, "portable", lambda df: df)
    for query, name in (("search_tree", "tree_search"), ("search_flat", "flat_search")):
        entry.queries()[query](None, "")
        got = asked[name]
        assert (got["prepared"], got["days"], got["trials"], got["sample_rows"]) == (
            "all lines", None, V.SEARCH_TRIALS, V.SEARCH_SAMPLE_ROWS) and got["combinations" if "tree" in name else "kinds"] in (None, ("RF", "LR"))
        entry.queries()[f"{query}_day5_two_trials"](None, "")
        assert asked[name]["sample_rows"] is None


def test_models_of_one_day_carry_no_other_days(spark):
    data = catalog._one_day_data(spark, str(FOLDER))
    assert set(data.base.selectExpr("map_keys(product_states.at) k").first()["k"]) == {0, 5}


def test_writes_split_methods_and_leave_the_setting(spark):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        with session.compiled(spark):
            seen.append(spark.conf.get(name))
        seen.append(spark.conf.get(name))
        first, second = session.compiled(spark), session.compiled(spark)
        first.__enter__(), second.__enter__(), first.__exit__(None, None, None)
        seen.append(spark.conf.get(name))
        second.__exit__(None, None, None)
        seen.append(spark.conf.get(name))
    finally:
        spark.conf.set(name, before)
    assert seen == ["8000", "65535", "8000", "65535"]
