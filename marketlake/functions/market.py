"""Price, date and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def partition_value(day: Column, granularity: str) -> Column:
    """The label of a day's partition: year, quarter, month or day."""
    if granularity == "quarter":
        return quarter_label(day)
    return F.date_format(day, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[granularity])


def lots_to_shares(lots: Column) -> Column:
    return F.coalesce(lots, F.lit(0)) * 100


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def ex_reference(prev_close: Column, cash: Column, bonus: Column, transfer: Column, allotment: Column, allotment_price: Column) -> Column:
    """The ex-rights reference price (P - D + A * PA) / (1 + B + T + A)."""
    paid = allotment * F.coalesce(allotment_price, F.lit(0.0))
    return (prev_close - cash + paid) / (1 + bonus + transfer + allotment)


def relative_bps(left: Column, right: Column) -> Column:
    """abs(l - r) / abs(r) * 1e4; with r = 0, 0 if both are and infinite otherwise."""
    return F.when(right == 0, F.when(left == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(F.abs(left - right), F.abs(right)) * 1e4)


def revision_id(columns: list[str]) -> Column:
    """SHA-256 of a fact's columns in canonical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def to_utc(value: Column) -> Column:
    return F.try_to_timestamp(value)


def placeholder_free() -> Column:
    return (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)


def traded() -> Column:
    return (F.col("volume") > 0) | F.col("volume").isNull()


def valid_bar() -> Column:
    """Positive prices, no negative turnover, and a closed candle envelope where anything traded."""
    envelope = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    sane = placeholder_free() & (F.coalesce(F.col("volume"), F.lit(0)) >= 0) & (F.coalesce(F.col("amount"), F.lit(0.0)) >= 0)
    return F.coalesce(sane & (~traded() | envelope), F.lit(False))


def finite(x: Column) -> Column:
    return x.isNull() | (~F.isnan(x) & (F.abs(x) != float("inf")))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def in_bar_session(ts: Column) -> Column:
    """Legal closing minutes of intraday bars."""
    t = clock(ts)
    return t.between("09:31:00", "11:30:00") | t.between("13:01:00", "15:00:00")


def in_tick_session(ts: Column) -> Column:
    t = clock(ts)
    return t.between("09:25:00", "09:25:59") | t.between("09:30:00", "11:30:00") | t.between("13:00:00", "15:00:00") | t.between("15:05:00", "15:30:00")


def elapsed_fraction(start: Column, end: Column, as_of: Column) -> Column:
    """The share of the period start..end (inclusive) that has passed at the end of ``as_of``."""
    whole = F.datediff(end, start) + 1
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.datediff(as_of, start) + 1) / whole))


def safe_turnover(amount: Column) -> Column:
    return F.when(amount >= 1, amount)


def industry_level(code: Column, level: str) -> Column:
    return F.substring(code, 1, {"L1": 2, "L2": 4, "L3": 6}[level])


def weight_or_null(w: Column) -> Column:
    return F.nullif(w, F.lit(0.0))
