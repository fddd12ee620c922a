"""Queries of what keeps hot keys, stored tables and streams within bounds: time slices, clustered files, kept statistics, deltas, timers, corrections, substring and rank selection."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import adjust, bars, contains, paging, slices
from ..sources import deltas, lake
from ..sources.atomic import AtomicPartitions
from ..sources.stats import Statistics
from ..streaming import bars as streams
from .core import query
from .derived import NORM
from .operators import HFQ, IN_SCOPE, KEY, QFQ, RET
from .own import TICK_SESSION, _drained, _landed_ticks, _stored

ONE = "600000.SH"


@query("j7_asof_one_symbol", "ticks", """
WITH t AS (SELECT event_id, trade_time, price, direction FROM ticks)
SELECT b.event_id, b.trade_time, s.price AS last_sell FROM (SELECT * FROM t WHERE direction = 'buy') b ASOF LEFT JOIN (SELECT * FROM t WHERE direction = 'sell') s ON b.trade_time >= s.trade_time""")
def _(fx):
    # All ticks are one symbol's: hours are dealt to tasks, and the last sale of each hour is carried on.
    t = fx("ticks").select(F.lit(ONE).alias("symbol"), "event_id", "trade_time", "price", "direction")
    sales = t.where("direction = 'sell'").select("symbol", F.col("trade_time").alias("sold_at"), F.col("price").alias("last_sell"))
    return slices.asof(t.where("direction = 'buy'"), sales, "symbol", "trade_time", "sold_at", "last_sell", slices.hours).select("event_id", "trade_time", "last_sell")


@query("j9_asof_sliced", "bars factor_events", """
SELECT b.symbol, b.trade_date, coalesce((SELECT max_by(e.factor, e.ex_date) FROM factor_events e WHERE e.symbol = b.symbol AND e.ex_date <= b.trade_date), 1.0) AS factor FROM bars b""")
def _(fx):
    return slices.asof(fx("bars").select(*KEY), fx("factor_events"), "symbol", "trade_date", "ex_date", "factor", slices.years, 1.0).select(*KEY, "factor")


@query("w5_sliced_returns", "bars factors", f"""WITH {HFQ} SELECT * FROM (SELECT symbol, trade_date, lag(trade_date) OVER w AS prev_date, close / lag(close) OVER w - 1 AS raw_ret, (close * factor) / lag(close * factor) OVER w - 1 AS adj_ret
  FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) x WHERE prev_date IS NOT NULL""")
def _(fx):
    return bars.raw_and_adjusted_returns(adjust.with_hfq(fx("bars"), fx("factors")), slices.years)


@query("w2_sliced_returns", "bars sessions", f"WITH {RET} SELECT symbol, trade_date, ret FROM rets")
def _(fx):
    return bars.session_returns(fx("bars"), fx("sessions"), by=slices.years).select(*KEY, "ret")


@query("w8_running_volume", "ticks", "SELECT event_id, CAST(sum(volume) OVER (ORDER BY trade_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS traded FROM ticks")
def _(fx):
    t = fx("ticks").select(F.lit(ONE).alias("symbol"), "event_id", "trade_time", "volume")
    return slices.running_sum(t, ["symbol"], "trade_time", slices.hours, "volume", "traded", ("event_id",)).select("event_id", "traded")


@query("s2_clustered_scan", "bars", "SELECT symbol, trade_date, close, true AS few_read FROM bars WHERE symbol = (SELECT min(symbol) FROM bars) AND year(trade_date) = 1997")
def _(fx):
    b = fx("bars")
    root = lake.work_dir(b.sparkSession, "s2-clustered")
    symbol = b.agg(F.min("symbol")).first()[0]
    lake.write_clustered(b, root, "trade_date", "year", page_rows=128)
    rows = lake.kept_rows(lake.scan(b.sparkSession, root, "trade_date", "1997-01-01", "1997-12-31", [symbol]).select(*KEY, "close"))
    label = lake.scan(b.sparkSession, root, "trade_date", "1997-01-01", "1997-12-31").count()
    return rows.table.withColumn("few_read", F.lit(rows.read["rows"] * 10 < label))


@query("m4_incremental_stats", "bars", """
SELECT CAST(year(trade_date) AS VARCHAR) AS label, 'tdx_protocol' AS source, CASE WHEN year(trade_date) = 1998 THEN 'v2' ELSE 'v1' END AS data_version, count(*) AS n_rows, true AS only_changed FROM bars GROUP BY 1, 2, 3, 5, year(trade_date)""")
def _(fx):
    home, b = _stored(fx, "m4-incremental")
    stats = Statistics(home.spark, home.path("daily_bars"), "trade_date")
    stats.refresh()
    # The label's rows as they are stored, not derived again; its old files go when the new ones are complete.
    stored = home.spark.read.parquet(home.path("daily_bars")).where("p_trade_date = 1998").select(b.columns)
    lake.write_partitions(stored.withColumn("data_version", F.lit("v2")), home.path("daily_bars"), "trade_date", "year")
    changed = stats.refresh()
    files = stats.files().where("label = '1998'").select("path").distinct().count()
    return stats.provenance().select("label", "source", "data_version", "n_rows", F.lit(changed == files).alias("only_changed"))


@query("m2_digest_adds_up", "bars", "SELECT CAST(year(trade_date) AS VARCHAR) AS label, count(*) AS n_rows, true AS adds_up FROM bars GROUP BY 1")
def _(fx):
    from ..operators.digest import of_frame

    home, b = _stored(fx, "m2-digest", again=True)
    stats = Statistics(home.spark, home.path("daily_bars"), "trade_date")
    stats.refresh()
    whole, one = of_frame(b), of_frame(b.where("year(trade_date) = 1997"))
    sums = whole == stats.digest() and one == stats.digest(["1997"]) and whole - one + one == whole and whole - one == of_frame(b.where("year(trade_date) <> 1997"))
    return stats.partitions().select("label", "n_rows", F.lit(sums).alias("adds_up"))


@query("m5_delta_chain", "bars backup_bars thinned_bars", "SELECT symbol, trade_date, close, volume FROM thinned_bars")
def _(fx):
    spark, at = fx("bars").sparkSession, lake.work_dir(fx("bars").sparkSession, "m5-chain")
    steps = [lake.kept(fx(name).select(*KEY, "close", "volume"), "m5") for name in ("bars", "backup_bars", "thinned_bars")]
    for i, (old, new) in enumerate(zip(steps, steps[1:])):
        deltas.make_delta(old, new, KEY, f"{at}/{i}")
    return deltas.apply_deltas(steps[0], [f"{at}/0", f"{at}/1"], KEY, f"{at}/out")


@contextmanager
def rocks_db(spark):
    """The state store that timers need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


@query("x4_day_findings", "ticks", f"""
SELECT symbol, trade_date, count(*) AS n, count(*) FILTER (WHERE NOT ({TICK_SESSION})) AS n_off, CAST(count(*) - count(DISTINCT tick_seq) AS BIGINT) AS n_repeated, CAST(min(tick_seq) AS BIGINT) AS lo, CAST(max(tick_seq) AS BIGINT) AS hi,
  CAST(max(tick_seq) - min(tick_seq) + 1 - count(DISTINCT tick_seq) AS BIGINT) AS n_missing
FROM (SELECT * FROM ticks UNION ALL SELECT * FROM ticks WHERE volume > 700) t WHERE trade_date + INTERVAL 1 DAY <= (SELECT max(trade_time) - INTERVAL 10 MINUTE FROM ticks) GROUP BY 1, 2""")
def _(fx):
    ticks, path = _landed_ticks(fx, "x4-timers")
    ticks.sparkSession.read.parquet(f"{path}/ticks").where("volume > 700").write.mode("append").parquet(f"{path}/ticks")
    with rocks_db(ticks.sparkSession):
        return _drained(streams.session_findings(ticks), path, "append")


@query("x2_corrected_bars", "ticks", """
WITH w AS (SELECT symbol, trade_date, time_bucket(INTERVAL 15 MINUTE, trade_time) AS bar_start, price, volume, tick_seq, trade_time, volume >= 800 AS late FROM ticks)
SELECT symbol, bar_start, min_by(price, struct_pack(t := trade_time, s := tick_seq)) AS open, max(price) AS high, min(price) AS low, max_by(price, struct_pack(t := trade_time, s := tick_seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_ticks,
  bool_or(late) AND NOT bool_and(late) AS replaced FROM w GROUP BY symbol, trade_date, bar_start""")
def _(fx):
    # A fifth of the ticks lands when all bars have been built.
    t = fx("ticks").select("symbol", "trade_date", "tick_seq", F.col("trade_time").cast("timestamp").alias("trade_time"), "price", "volume")
    path = lake.work_dir(t.sparkSession, "x2-corrections")
    stream = lambda: t.sparkSession.readStream.schema(t.schema).parquet(f"{path}/in")
    for landed in ("volume < 800", "volume >= 800"):
        t.where(landed).write.mode("append").parquet(f"{path}/in")
        streams.correcting_bars(stream(), f"{path}/out", f"{path}/checkpoint", 15).awaitTermination()
    found = t.sparkSession.read.parquet(f"{path}/out/bars")
    log = t.sparkSession.read.parquet(f"{path}/out/revisions").groupBy("symbol", "bar_start").agg(F.bool_or("replaced").alias("replaced"))
    return found.join(log, ["symbol", "bar_start"]).select("symbol", "bar_start", "open", "high", "low", "close", "volume", "n_ticks", "replaced")


@query("j21_substring_tiers", "boards board_indices", f"""
WITH l AS (SELECT DISTINCT {NORM.format('sector_name')} AS k FROM boards), r AS (SELECT DISTINCT {NORM.format('trim(name)')} AS k FROM board_indices)
SELECT l.k AS board, r.k AS index_name, CASE WHEN l.k = r.k THEN 'equal' WHEN contains(r.k, l.k) THEN 'inside' ELSE 'around' END AS tier FROM l JOIN r ON l.k <> '' AND r.k <> '' AND (contains(r.k, l.k) OR contains(l.k, r.k))""")
def _(fx):
    from ..functions.text import sector_name

    left = fx("boards").select(sector_name(F.col("sector_name")).alias("left"))
    right = fx("board_indices").select(sector_name(F.trim("name")).alias("right"))
    tier = F.when(F.col("left") == F.col("right"), "equal").when(F.contains("right", F.col("left")), "inside").otherwise("around")
    return contains.overlapping(left, right).select(F.col("left").alias("board"), F.col("right").alias("index_name"), tier.alias("tier"))


@query("s11_sql_function", "bars factors", f"""WITH b AS (SELECT * FROM bars WHERE {IN_SCOPE}), {HFQ.replace('FROM bars b', 'FROM b')}{QFQ.format(f='factors', b='b')}
SELECT symbol, trade_date, adj_is_exact, close * qfq_factor AS adj_close FROM q""")
def _(fx):
    spark = fx("bars").sparkSession
    lake.register_views({"s11_bars": fx("bars"), "s11_factors": fx("factors")})
    adjust.register_qfq_function(spark, "s11_bars", "s11_factors", "s11_daily_bars_qfq")
    return spark.sql("SELECT symbol, trade_date, adj_is_exact, adj_close FROM s11_daily_bars_qfq(DATE '1996-01-01', DATE '1998-12-31')")


@query("s12_observed_total", "bars", "SELECT symbol, trade_date, close, (SELECT count(*) FROM bars WHERE volume > 20) AS total FROM bars WHERE volume > 20 ORDER BY symbol, trade_date LIMIT 50")
def _(fx):
    lake.register_views({"s12_bars": fx("bars")})
    page, total = lake.run_sql(fx("bars").sparkSession, "SELECT symbol, trade_date, close FROM s12_bars WHERE volume > 20 ORDER BY symbol, trade_date", 50)
    return page.withColumn("total", F.lit(total).cast("long"))


@query("t2_compound_cursor", "bars", "SELECT trade_date, symbol, close FROM bars WHERE (trade_date, symbol) > (DATE '1997-03-03', '300030.SZ') ORDER BY trade_date, symbol LIMIT 201")
def _(fx):
    return paging.keyset_page(fx("bars").select("trade_date", "symbol", "close"), ["trade_date", "symbol"], ["1997-03-03", "300030.SZ"], 200)


@query("s17_atomic_replace", "bars", "SELECT symbol, trade_date, CASE WHEN year(trade_date) = 1997 THEN close * 2 ELSE close END AS close, close AS before FROM bars WHERE trade_date BETWEEN DATE '1996-07-01' AND DATE '1998-06-30'")
def _(fx):
    b = fx("bars")
    table = AtomicPartitions(b.sparkSession, lake.work_dir(b.sparkSession, "s17-atomic"), "trade_date", "quarter")
    table.replace(b)
    # Opened before the label is replaced, read after it.
    before = table.read("1996-07-01", "1998-06-30").select(*KEY, F.col("close").alias("before"))
    table.replace(b.where("year(trade_date) = 1997").withColumn("close", F.col("close") * 2))
    return table.read("1996-07-01", "1998-06-30").select(*KEY, "close").join(before, KEY)
