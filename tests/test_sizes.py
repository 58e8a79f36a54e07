"""Queries write and shuffle no more than they need; the rows stay the same."""

from __future__ import annotations

import datetime
import io
from contextlib import redirect_stdout
from pathlib import Path

from pyspark import cloudpickle

from ordersight.functions import values as V
from ordersight.operators import features as X
from ordersight.operators import routing as R
from ordersight.operators import splits as S
from ordersight.operators.hierarchy import ClassTree
from ordersight.plans import catalog, search
from ordersight.plans.prepare import clean
from ordersight.sources import star
from ordersight.streaming import daily

FOLDER = str(Path("/root/testdata/sf0.001"))


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def rows_of(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_queries_of_few_columns_write_these_alone(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_WRITTEN", {})
    written = []
    monkeypatch.setattr(catalog, "written", lambda df, name: written.append((name, df.columns)) or df)
    for query in ("validation_split", "seeded_sample", "order_flags", "group_onehot", "known_flags_x",
                  "asof_product_x", "historic_product_group_x"):
        catalog.QUERIES[query](spark, FOLDER)
    assert len(written) == 6  # the split and the sample share one table
    assert all(name == "prepared" and len(columns) < 20 for name, columns in written)
    assert written[0] == ("prepared", [V.KEY, V.DATE])
    whole = catalog._prepared(spark, FOLDER)
    assert len(whole.columns) > 80
    assert catalog._columns(spark, FOLDER, V.KEY).columns == [V.KEY]  # of the whole table, once it is there
    assert len(written) == 7


def test_columns_hold_all_that_matrices_and_splits_read(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_WRITTEN", {})
    some = catalog._columns(spark, FOLDER, *X.MATRIX_COLUMNS)
    few = catalog._columns(spark, FOLDER, V.KEY, V.DATE)
    whole = catalog._prepared(spark, FOLDER)
    assert rows_of(X.feature_matrix(some, 5)) == rows_of(X.feature_matrix(whole, 5))
    assert rows_of(S.validation_split(few)) == rows_of(S.validation_split(whole.select(V.KEY, V.DATE)))


def test_history_of_scores_shuffles_no_row_per_day(spark):
    dealt, plain = (star.scores(spark, FOLDER, [0, 1, 2], by_key=k) for k in (True, False))
    histories = [R.carry_over(R.route(s, catalog.TREE, catalog.FIXED), catalog.TREE) for s in (dealt, plain)]
    above = [plan_of(h).split("Generate")[0] for h in histories]
    assert "Exchange" not in above[0]
    assert "Exchange" in above[1]
    assert rows_of(histories[0]) == rows_of(histories[1])


def prepared_lines(raw):
    """Lines of three products and two sellers on fifteen days; some are returned."""
    first = datetime.date(2020, 3, 2)
    return clean(raw(*[{
        "productId": i % 3, "sellerId": i % 2, "orderDate": first + datetime.timedelta(i * i % 15), "quantityOrdered": 1.0 + i % 4,
        **({"returnDateTime": datetime.datetime(2020, 3, 20 + i % 5, 9), "quanityReturned": 1.0, "noReturn": False} if i % 4 == 0 else {}),
    } for i in range(60)]))


def test_the_cuts_are_searched_in_dates_and_keys_alone(spark, raw, monkeypatch):
    """The matrix of the first day is made once, not again for each pass of the search."""
    seen, real = [], daily.cuts_at
    monkeypatch.setattr(daily, "cuts_at", lambda df, positions: seen.append(df) or real(df, positions))
    data = daily.DayData.build(prepared_lines(raw), [5])
    assert seen[0].columns == [V.KEY, V.DATE] and "product_states" not in plan_of(seen[0])
    assert real(X.matrix_of_day(data.base, 5), S.test_positions)[1] == data.cuts != [None, None]


def test_product_history_is_the_state_that_each_day_sees(spark, raw):
    prepared, days = prepared_lines(raw), [0, 1, 5, 10]
    history, states = X.product_history(prepared, days), X.product_states(prepared, days)
    assert "collect_list" not in plan_of(history)
    assert rows_of(history) == rows_of(states.select(
        "productId", "day", *[X._state_of("product", x).alias(f"product_{x}") for x in days]))


def test_choices_are_sent_without_this_package(spark, monkeypatch):
    class Table:
        def select(self, *columns):
            return self

        where = select

        def mapInArrow(self, function, schema):
            return function
    monkeypatch.setattr(search, "matrices_of_days", lambda base, days: Table())
    monkeypatch.setattr(search, "assembled", lambda df, features: df)
    monkeypatch.setattr(search, "written", lambda df, name: df)
    tree = ClassTree.satisfaction()
    stages, number = tree.stages(), {n: i for i, n in enumerate([tree.root, *tree.parents])}
    held = type("Held", (), {"held_out_lines": lambda self: Table()})()
    run = search._choice_table(held, [5], {5: search._Day([[] for _ in stages])}, stages, number, {}, [], tree, False)
    assert b"ordersight.operators.hierarchy" not in cloudpickle.dumps(run)
