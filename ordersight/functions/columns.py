"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(predicate: Column) -> Column:
    """A predicate in which a missing operand means "no", as in a comparison with NaT or NaN."""
    return F.coalesce(predicate, F.lit(False))


def missing_is_true(column: Column) -> Column:
    return F.coalesce(column.cast("boolean"), F.lit(True))


def natural_log(x: Column) -> Column:
    """ln with -Infinity at zero and NULL below it (Spark's ln gives NULL for both)."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def ratio(a: Column, b: Column) -> Column:
    """IEEE quotient: Infinity for a positive value over zero, NULL for zero over zero."""
    return F.when((b == 0) & (a > 0), F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def day_number(date: Column) -> Column:
    return F.unix_date(date.cast("date"))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later.cast("date"), earlier.cast("date"))


def first_day_at_or_after(moment: Column) -> Column:
    """Number of the first day whose midnight is not before the moment."""
    midnight = moment.cast("date")
    return F.unix_date(midnight) + (moment > midnight.cast("timestamp")).cast("int")


def percent(part: Column, total: Column) -> Column:
    """Share in percent, two decimals, half to even; 0 when there is nothing to share."""
    share = F.try_divide(part, total) * 100
    return F.coalesce(F.rint(share * 100) / 100, F.lit(0.0))


def grouped(value: Column, groups: dict[str, list[str]], default: str) -> Column:
    """The group a code belongs to; the default for unlisted and missing codes."""
    out = None
    for group, members in groups.items():
        hit = value.isin(members)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(default)


def lookup(mapping: dict, key: Column, value_type: str) -> Column:
    """Value of a small driver-side dict for a key column, NULL where the key is absent."""
    if not mapping:
        return F.lit(None).cast(value_type)
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v).cast(value_type))]
    return F.try_element_at(F.create_map(*pairs), key)


def same(a: Column, b: Column) -> Column:
    return holds(a == b)
