"""Reports over several datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import in_universe
from ..operators.asof import latest_snapshot
from ..operators.universe import listed, uncovered


def symbol_summary(bars: DataFrame, status: DataFrame, valuations: DataFrame, members: DataFrame) -> DataFrame:
    """The latest bar, status, valuation and industry of every symbol."""
    last = F.struct("trade_date", "fetched_at", "source")
    b = bars.groupBy("symbol").agg(F.max("trade_date").alias("bar_date"), F.max_by("close", last).alias("close"))
    s = status.groupBy("symbol").agg(F.max_by("status", last).alias("status"))
    v = valuations.groupBy("symbol").agg(F.max_by("pe_ttm", "trade_date").alias("pe_ttm"))
    m = latest_snapshot(members, "as_of_date").select("symbol", "industry_code")
    return b.join(s, "symbol", "left").join(v, "symbol", "left").join(m, "symbol", "left")


def kline_pages(bars: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Each symbol's next ``limit`` bars after the cursor, and one more to tell that others follow."""
    w = Window.partitionBy("symbol").orderBy(key)
    return bars.where(F.col(key) > F.lit(cursor)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit + 1).drop("_rn")


def historical_validity(bars: DataFrame, instruments: DataFrame, status: DataFrame, sessions: DataFrame) -> DataFrame:
    """What blocks a strict historical universe, counted."""
    inside = listed(bars, instruments)
    gone = instruments.where(F.col("delist_date").isNotNull() & in_universe(F.col("symbol")))
    parts = {
        "st_evidence": uncovered(inside, status),
        "interior_sessions": sessions.join(inside.select("trade_date").distinct(), "trade_date", "left_anti"),
        "delisted_universe": gone.join(inside.select("symbol").distinct(), "symbol", "left_anti"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("blocker"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def tier_rollup(catalog: DataFrame, tiers: DataFrame, anchor, tolerance_days: int) -> DataFrame:
    """Datasets, rows and freshness per tier."""
    lag = F.datediff(F.lit(anchor).cast("date"), F.col("coverage_end"))
    state = F.when(F.col("n_rows") == 0, "empty").when(lag > tolerance_days, "stale").otherwise("fresh")
    return catalog.join(F.broadcast(tiers), "dataset").withColumn("state", state).groupBy("tier", "state").agg(F.count("*").alias("n_datasets"), F.sum("n_rows").alias("n_rows"))
