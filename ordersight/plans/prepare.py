"""Raw order lines to the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ordersight.operators import cleaning as C


def typed(raw: DataFrame) -> DataFrame:
    """Names, labels and flags put right; every row is still there."""
    return C.cast_flags(C.rename_recode(raw))


def clean(raw: DataFrame, flags: C.CalendarFlags = C.CalendarFlags()) -> DataFrame:
    """The prepared table: one narrow stage, in which a scan reads only the columns used later."""
    df = C.repair(C.remove_noise(typed(raw)))
    df = C.with_offsets(C.with_price(df))
    df = C.with_calendar(df, flags)
    df = C.with_classes(C.with_order_flags(df))
    return C.with_product_group(C.with_transporter(df))
