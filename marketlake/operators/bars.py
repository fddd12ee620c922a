"""Bars over periods and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import traded
from . import slices


def by_symbol():
    return Window.partitionBy("symbol").orderBy("trade_date")


def period_bars(bars: DataFrame, period: str) -> DataFrame:
    """Weekly (Monday) or monthly bars: first open, extremes, last close, sums, period bounds, last factor and whether all are exact."""
    start = F.date_trunc(period, F.col("trade_date")).cast("date")
    extra = [F.max_by("factor", "trade_date").alias("factor"), F.bool_and("adj_is_exact").alias("adj_is_exact")] if "factor" in bars.columns else []
    return bars.groupBy("symbol", start.alias("period_start")).agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("n_bars"),
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), *extra,
    )


def period_page(bars: DataFrame, period: str, cursor=None, limit: int = 100) -> DataFrame:
    """One symbol's weekly or monthly bars after ``cursor`` (a period start), and one more to tell whether others follow; adjusted prices where they are there."""
    prices = [c for c in ("open", "high", "low", "close") if f"adj_{c}" in bars.columns]
    whole = period_bars(bars.withColumns({c: F.col(f"adj_{c}") for c in prices}), period)
    after = whole if cursor is None else whole.where(F.col("period_start") > F.lit(cursor).cast("date"))
    return after.orderBy("period_start").limit(limit + 1)


def upsample(bars: DataFrame, minutes: int) -> DataFrame:
    """Right-closed intraday windows labelled by their end."""
    end = F.window(F.col("bar_time") - F.expr("INTERVAL '1' MICROSECOND"), f"{minutes} minutes").end
    return bars.groupBy("symbol", "trade_date", end.alias("bar_end")).agg(
        F.min_by("open", "bar_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_time").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count("*").alias("n_bars"),
    )


def session_returns(bars: DataFrame, sessions: DataFrame, price: str = "close", by: Callable | None = None) -> DataFrame:
    """Return since the previous traded bar, only where that bar is of the previous session; ``by`` (see ``slices``) deals a symbol to many tasks."""
    inside = bars.where(traded())
    if by is None:
        lagged = inside.select("*", F.lag(price).over(by_symbol()).alias("prev_price"), F.lag("trade_date").over(by_symbol()).alias("prev_bar"))
    else:
        lagged = slices.previous(inside, ["symbol"], "trade_date", by, {"prev_price": price, "prev_bar": "trade_date"})
    near = lagged.join(F.broadcast(sessions.select("trade_date", "prev_date")), "trade_date").where("prev_bar = prev_date")
    ret = F.try_divide(F.col(price), F.col("prev_price")) - 1
    return near.withColumn("ret", ret).where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") != float("inf"))).drop("prev_price", "prev_bar", "prev_date")


def raw_and_adjusted_returns(bars: DataFrame, by: Callable | None = None) -> DataFrame:
    """Raw and adjusted return and the previous date, over bars with a factor column; ``by`` deals a symbol to many tasks."""
    adjusted = bars.select("symbol", "trade_date", "close", (F.col("close") * F.col("factor")).alias("_adj"))
    before = {"prev_date": "trade_date", "_close": "close", "_prev_adj": "_adj"}
    if by is None:
        w = by_symbol()
        lagged = adjusted.select("*", *(F.lag(c).over(w).alias(new) for new, c in before.items()))
    else:
        lagged = slices.previous(adjusted, ["symbol"], "trade_date", by, before)
    ret = lambda now, then: F.try_divide(F.col(now), F.col(then)) - 1
    return lagged.where("prev_date IS NOT NULL").select("symbol", "trade_date", "prev_date", ret("close", "_close").alias("raw_ret"), ret("_adj", "_prev_adj").alias("adj_ret"))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cumulative_return(df: DataFrame, price: str) -> DataFrame:
    first = F.first(price).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cum_ret", F.try_divide(F.col(price), first) - 1)


def own_history_percentile(df: DataFrame, metric: str) -> DataFrame:
    return df.withColumn("pct_rank", F.percent_rank().over(Window.partitionBy("symbol").orderBy(metric)))


def group_returns(rets: DataFrame, keys: list[str]) -> DataFrame:
    """Equal and amount-weighted mean return, members counted exactly."""
    weighted = F.try_divide(F.sum(F.when(F.col("amount").isNotNull(), F.col("ret") * F.col("amount"))), F.sum("amount"))
    return rets.groupBy(*keys).agg(F.avg("ret").alias("equal_ret"), weighted.alias("amount_ret"), F.countDistinct("symbol").alias("n_symbols"))


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.countDistinct("trade_date").alias("n_dates"))


def previous_session(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Traded bars with the close of the previous calendar session (a placeholder's counts); bars are one row per symbol and day.

    Only bars of sessions stay, so the previous bar of a symbol is that of the previous session if it has one: one window, no self-join.
    """
    w = by_symbol()
    inside = bars.join(F.broadcast(sessions.select("trade_date", "prev_date")), "trade_date")
    lagged = inside.select("*", F.lag("trade_date").over(w).alias("_before"), F.lag("close").over(w).alias("prev_close"))
    return lagged.where(traded() & (F.col("_before") == F.col("prev_date"))).drop("_before")


def contiguous_prefix(expected: DataFrame, present: DataFrame, key: list[str], day: str = "trade_date") -> DataFrame:
    """Per key, the last expected day before the first that is missing (null when the first is missing)."""
    seen = present.select(*key, day).distinct().withColumn("_there", F.lit(1))
    w = Window.partitionBy(*key).orderBy(day)
    joined = expected.select(*key, day).join(seen, [*key, day], "left")
    run = joined.withColumn("_holes", F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0)).over(w))
    return run.groupBy(*key).agg(F.max(F.when(F.col("_holes") == 0, F.col(day))).alias("last_contiguous"))


def gap_runs(expected: DataFrame, present: DataFrame, key: list[str], day: str = "trade_date") -> DataFrame:
    """Runs of consecutive expected days that are missing (gaps and islands)."""
    seen = present.select(*key, day).distinct().withColumn("_there", F.lit(1))
    w = Window.partitionBy(*key).orderBy(day)
    numbered = expected.select(*key, day).join(seen, [*key, day], "left").withColumn("_n", F.row_number().over(w))
    missing = numbered.where("_there IS NULL").withColumn("_island", F.col("_n") - F.row_number().over(w))
    return missing.groupBy(*key, "_island").agg(F.min(day).alias("gap_start"), F.max(day).alias("gap_end"), F.count("*").alias("n_missing")).drop("_island")
