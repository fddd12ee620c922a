"""Price adjustment (J1-J3, S10, S11, D22, D24, D25). Only backward (hfq) factors are stored; forward (qfq) ones follow from an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


class MissingFactors(ValueError):
    """Strict adjustment met bars without a factor."""


def with_hfq(bars: DataFrame, factors: DataFrame, strict: bool = False) -> DataFrame:
    """Left join on (symbol, trade_date): factor (1.0 where missing) and adj_is_exact."""
    f = factors.where("adjust_type = 'hfq'").select("symbol", "trade_date", F.col("factor").alias("_factor"))
    joined = bars.join(f, ["symbol", "trade_date"], "left")
    out = joined.select(*bars.columns, F.coalesce("_factor", F.lit(1.0)).alias("factor"), F.col("_factor").isNotNull().alias("adj_is_exact"))
    if strict and (n := out.where("NOT adj_is_exact").count()):
        raise MissingFactors(f"{n} bars have no factor")
    return out


def scaled(df: DataFrame, by: str, prefix: str = "adj_") -> DataFrame:
    prices = [c for c in (*PRICES, "price") if c in df.columns]
    return df.select("*", *((F.col(c) * F.col(by)).alias(f"{prefix}{c}") for c in prices))


def hfq(bars: DataFrame, factors: DataFrame, strict: bool = False) -> DataFrame:
    return scaled(with_hfq(bars, factors, strict), "factor")


def anchors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Per symbol, the latest factor at or before its last bar."""
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("_last"))
    f = factors.where("adjust_type = 'hfq'").select("symbol", "trade_date", "factor")
    return f.join(last, "symbol").where("trade_date <= _last").groupBy("symbol").agg(F.max_by("factor", "trade_date").alias("anchor"))


def _forward(bars: DataFrame, factors: DataFrame, anchor: DataFrame, strict: bool) -> DataFrame:
    """A missing factor leaves the price as it is and the row inexact."""
    adjusted = with_hfq(bars, factors, strict).join(anchor, "symbol", "left")
    ratio = F.when(F.col("adj_is_exact") & (F.col("anchor") != 0), F.col("factor") / F.col("anchor")).otherwise(1.0)
    return scaled(adjusted.withColumn("qfq_factor", ratio), "qfq_factor").drop("anchor")


def forward_in_scope(bars: DataFrame, factors: DataFrame, strict: bool = False) -> DataFrame:
    """Anchor (a) over frames that are limited to the window already."""
    return _forward(bars, factors, anchors(bars, factors), strict)


def qfq_in_scope(bars: DataFrame, factors: DataFrame, start, end, strict: bool = False) -> DataFrame:
    """Anchor (a): bars and factors both limited to the window."""
    inside = F.col("trade_date").between(F.lit(start), F.lit(end))
    return forward_in_scope(bars.where(inside), factors.where(inside), strict)


def qfq_whole_lake(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Anchor (b), the view: the latest factor at or before the last bar in the lake."""
    return _forward(bars, factors, anchors(bars, factors), False)


def qfq_window(bars: DataFrame, factors: DataFrame, start=None, end=None) -> DataFrame:
    """Anchor (b), the macro: the last bar in the window, factors without a lower bound; a null bound is open."""
    b = bars
    b = b.where(F.col("trade_date") >= F.lit(start)) if start is not None else b
    b = b.where(F.col("trade_date") <= F.lit(end)) if end is not None else b
    return _forward(b, factors, anchors(b, factors), False)


def register_qfq_function(spark: SparkSession, bars: str = "daily_bars", factors: str = "adj_factors", name: str = "daily_bars_qfq") -> None:
    """``name(start_date, end_date)`` as a table function of free SQL over two views, with the anchors of ``qfq_window``; null or absent bounds are open."""
    prices = ", ".join(f"b.{c} * r.ratio AS adj_{c}" for c in PRICES)
    columns = ", ".join(f"{c} DOUBLE" for c in (*PRICES, *(f"adj_{c}" for c in PRICES)))
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION {name}(start_date DATE DEFAULT NULL, end_date DATE DEFAULT NULL)
      RETURNS TABLE (symbol STRING, trade_date DATE, {columns}, volume BIGINT, amount DOUBLE, qfq_factor DOUBLE, adj_is_exact BOOLEAN)
      RETURN
        WITH inside AS (
          SELECT * FROM {bars} v WHERE (start_date IS NULL OR v.trade_date >= start_date) AND (end_date IS NULL OR v.trade_date <= end_date)),
        known AS (SELECT symbol, trade_date, factor FROM {factors} WHERE adjust_type = 'hfq'),
        last_bar AS (SELECT symbol, max(trade_date) AS last_date FROM inside GROUP BY symbol),
        anchors AS (SELECT k.symbol, max_by(k.factor, k.trade_date) AS anchor FROM known k JOIN last_bar l ON k.symbol = l.symbol AND k.trade_date <= l.last_date GROUP BY k.symbol),
        r AS (
          SELECT i.*, k.factor IS NOT NULL AS is_exact, CASE WHEN k.factor IS NOT NULL AND a.anchor <> 0 THEN k.factor / a.anchor ELSE 1.0D END AS ratio
          FROM inside i LEFT JOIN known k ON i.symbol = k.symbol AND i.trade_date = k.trade_date LEFT JOIN anchors a ON i.symbol = a.symbol)
        SELECT r.symbol, r.trade_date, {", ".join(f"r.{c}" for c in PRICES)}, {prices.replace("b.", "r.")}, r.volume, r.amount, r.ratio, r.is_exact FROM r""")


def qfq_base_date(bars: DataFrame, factors: DataFrame, base_date, strict: bool = False) -> DataFrame:
    """Anchor (c): the factor on ``base_date`` itself; a row is exact when both factors exist."""
    base = factors.where((F.col("trade_date") == F.lit(base_date)) & (F.col("adjust_type") == "hfq")).select("symbol", F.col("factor").alias("_base"))
    joined = with_hfq(bars, factors).join(base, "symbol", "left")
    exact = F.col("adj_is_exact") & F.col("_base").isNotNull() & (F.coalesce("_base", F.lit(0.0)) > 0)
    out = joined.withColumn("adj_is_exact", exact).withColumn("qfq_factor", F.when(exact, F.col("factor") / F.col("_base")).otherwise(1.0)).drop("_base")
    if strict and (n := out.where("NOT adj_is_exact").count()):
        raise MissingFactors(f"{n} bars have no factor or no base factor")
    return scaled(out, "qfq_factor")


def daily_bars_adj(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Raw, hfq_* and qfq_* prices side by side; adj_close is the forward-adjusted close."""
    both = with_hfq(bars, factors).join(anchors(bars, factors), "symbol", "left")
    ratio = F.when(F.col("adj_is_exact") & (F.col("anchor") != 0), F.col("factor") / F.col("anchor")).otherwise(1.0)
    out = scaled(scaled(both.withColumn("_q", ratio), "factor", "hfq_"), "_q", "qfq_")
    return out.withColumn("adj_close", F.col("qfq_close")).drop("_q", "anchor")


def factor_page(factors: DataFrame, base_date=None) -> DataFrame:
    """Finite, positive factors; with a base date, divided by the symbol's factor of that day."""
    sound = factors.where((F.col("factor") > 0) & ~F.isnan("factor") & (F.col("factor") != float("inf")))
    if base_date is None:
        return sound
    base = sound.where(F.col("trade_date") == F.lit(base_date)).select("symbol", F.col("factor").alias("_base"))
    return sound.join(base, "symbol").withColumn("factor", F.col("factor") / F.col("_base")).drop("_base")
