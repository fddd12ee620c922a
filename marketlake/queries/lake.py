"""Queries of scans, scalars, pages, catalogues and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as M
from ..functions import symbols as S
from ..functions import text as T
from ..operators import paging
from ..operators.bars import contiguous_prefix
from ..plans.reports import tier_rollup
from ..sources import lake
from .core import query
from .derived import NEGATIVE, POSITIVE, _sentiment_sql
from .operators import KEY, etf_sql, universe_sql


@query("s1_pruned_scan", "bars", "SELECT symbol, trade_date, close FROM bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND symbol IN ('600004.SH', '000005.SZ')")
def _(fx):
    rows = fx("bars").where(F.col("trade_date").between("1997-01-01", "1998-06-30") & F.col("symbol").isin("600004.SH", "000005.SZ"))
    return rows.select(*KEY, "close")


@query("s4_union_by_name", "bars bars_raw", "SELECT symbol, trade_date, close, CAST(NULL AS VARCHAR) AS source FROM bars UNION ALL SELECT symbol, trade_date, close, source FROM bars_raw")
def _(fx):
    return fx("bars").select(*KEY, "close").unionByName(fx("bars_raw").select(*KEY, "close", "source"), allowMissingColumns=True)


@query("s12_free_sql", "bars", "SELECT split_part(symbol, '.', 2) AS exchange, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ROLLUP (1, 2)")
def _(fx):
    return fx("bars").sparkSession.sql(
        "SELECT substring_index(symbol, '.', -1) AS exchange, year(trade_date) AS year, count(*) AS n, sum(volume) AS volume FROM {b} GROUP BY ROLLUP (substring_index(symbol, '.', -1), year(trade_date))", b=fx("bars")
    )


@query("s14_catalog", "bars ticks facts", """
SELECT 'daily_bars' AS dataset, count(*) AS n_rows, min(trade_date) AS coverage_start, max(trade_date) AS coverage_end FROM bars UNION ALL SELECT 'financial_statement_items', count(*), min(announce_date), max(announce_date) FROM facts UNION ALL SELECT 'trade_ticks', count(*), min(trade_date), max(trade_date) FROM ticks""")
def _(fx):
    return lake.catalog({"daily_bars": (fx("bars"), "trade_date"), "trade_ticks": (fx("ticks"), "trade_date"), "financial_statement_items": (fx("facts"), "announce_date")})


@query("s18_partition_values", "bars", "SELECT DISTINCT trade_date, CAST(year(trade_date) AS VARCHAR) AS y, year(trade_date) || 'Q' || quarter(trade_date) AS q, strftime(trade_date, '%Y-%m') AS m FROM bars")
def _(fx):
    d = F.col("trade_date")
    return fx("bars").select("trade_date", M.partition_value(d, "year").alias("y"), M.partition_value(d, "quarter").alias("q"), M.partition_value(d, "month").alias("m")).distinct()


@query("s3_label_pruning", "bars", "SELECT DISTINCT strftime(trade_date, '%Y-%m') AS label FROM bars WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1997-08-31'")
def _(fx):
    labels = fx("bars").select(M.partition_value(F.col("trade_date"), "month").alias("label")).distinct()
    return labels.where(lake.overlaps(F.col("label"), "1996-03-15", "1997-08-02"))


@query("a13_provenance", "bars_raw", "SELECT strftime(trade_date, '%Y-%m') AS label, source, data_version, count(*) AS n_rows, min(fetched_at) AS first_fetch, max(fetched_at) AS last_fetch FROM bars_raw GROUP BY 1, 2, 3")
def _(fx):
    return lake.provenance(fx("bars_raw"), "trade_date", "month")


@query("a14_provenance_series", "bars_raw", "SELECT CAST(year(trade_date) AS VARCHAR) AS label, source, count(*) AS n_rows FROM bars_raw GROUP BY 1, 2")
def _(fx):
    return lake.provenance_series(fx("bars_raw"), "trade_date", 12).select("label", "source", "n_rows")


@query("m5_delta", "bars backup_bars", """
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.trade_date, n.trade_date) AS trade_date, CASE WHEN o.symbol IS NULL THEN 'add' WHEN n.symbol IS NULL THEN 'delete' ELSE 'replace' END AS change
FROM bars o FULL JOIN backup_bars n ON o.symbol = n.symbol AND o.trade_date = n.trade_date WHERE o.symbol IS NULL OR n.symbol IS NULL OR o.close IS DISTINCT FROM n.close""")
def _(fx):
    return lake.delta(fx("bars"), fx("backup_bars"), KEY)


def _watermark_sql(rows: str) -> str:
    return f"""
WITH c AS (SELECT s.trade_date, b.trade_date IS NULL AS hole FROM sessions s LEFT JOIN (SELECT DISTINCT trade_date FROM {rows}) b ON s.trade_date = b.trade_date), r AS (SELECT *, sum(CASE WHEN hole THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS n FROM c)
SELECT 'daily_bars' AS dataset, max(CASE WHEN n = 0 THEN trade_date END) AS last_contiguous FROM r"""


def _watermark(sessions, present):
    tag = F.lit("daily_bars").alias("dataset")
    return contiguous_prefix(sessions.select(tag, "trade_date"), present.select(tag, "trade_date"), ["dataset"])


@query("m7_watermark", "bars sessions", _watermark_sql("bars"))
def _(fx):
    return _watermark(fx("sessions"), fx("bars"))


@query("m7_watermark_planted", "late_bars sessions", _watermark_sql("late_bars"))
def _(fx):
    return _watermark(fx("sessions"), fx("late_bars"))


@query("m9_incremental_sessions", "sessions", "SELECT trade_date FROM sessions WHERE trade_date > DATE '2000-12-31' AND trade_date <= DATE '2001-03-31'")
def _(fx):
    return lake.incremental_sessions(fx("sessions"), "2000-12-31", "2001-03-31").select("trade_date")


@query("m10_newest_run", "bars_raw", "SELECT b.symbol, b.trade_date, b.source FROM bars_raw b JOIN (SELECT symbol, max(fetched_at) AS f FROM bars_raw GROUP BY 1) m ON b.symbol = m.symbol AND b.fetched_at = m.f")
def _(fx):
    return lake.newest_run(fx("bars_raw").withColumnRenamed("fetched_at", "run_ts"), ["symbol"]).select(*KEY, "source")


@query("m11_stale_runs", "bars_raw", "SELECT symbol, trade_date, source FROM bars_raw WHERE date_diff('day', CAST(fetched_at AS DATE), DATE '2001-10-31') > 365")
def _(fx):
    return lake.stale_runs(fx("bars_raw").withColumnRenamed("fetched_at", "run_ts"), "2001-10-31", 365).select(*KEY, "source")


@query("d42_tier_rollup", "bars ticks facts", """
WITH c AS (SELECT 'L1' AS tier, count(*) AS n, max(trade_date) AS e FROM bars UNION ALL SELECT 'L1', count(*), max(trade_date) FROM ticks UNION ALL SELECT 'L3', count(*), max(announce_date) FROM facts)
SELECT tier, CASE WHEN n = 0 THEN 'empty' WHEN date_diff('day', e, DATE '2001-12-01') > 30 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY 1, 2""")
def _(fx):
    from ..registry import DATASETS

    frames = {"daily_bars": (fx("bars"), "trade_date"), "trade_ticks": (fx("ticks"), "trade_date"), "financial_statement_items": (fx("facts"), "announce_date")}
    tiers = fx("bars").sparkSession.createDataFrame([(d.name, d.tier) for d in DATASETS.values()], "dataset string, tier string")
    return tier_rollup(lake.catalog(frames), tiers, "2001-12-01", 30)


@query("f1_symbol_parts", "instruments", f"""
SELECT symbol, split_part(symbol, '.', 1) AS code, split_part(symbol, '.', 2) AS exchange, CASE WHEN left(symbol, 2) IN ('60', '68') THEN 'SH' WHEN left(symbol, 2) IN ('92', '43', '83', '87') THEN 'BJ' ELSE 'SZ' END AS inferred,
  {etf_sql('symbol')} AS is_etf, {universe_sql('symbol')} AS in_all_a, false AS is_cdr FROM instruments""")
def _(fx):
    s = F.col("symbol")
    c, e = S.code(s), S.exchange(s)
    return fx("instruments").select("symbol", c.alias("code"), e.alias("exchange"), S.infer_exchange(c).alias("inferred"), S.is_etf(c, e).alias("is_etf"), S.in_universe(s).alias("in_all_a"), S.is_cdr(c, e).alias("is_cdr"))


@query("f5_f24_scalars", "bars", """
SELECT symbol, trade_date, volume * 100 AS shares, CAST(date_trunc('week', trade_date) AS DATE) AS week_start, CAST(date_trunc('month', trade_date) AS DATE) AS month_start, last_day(trade_date) AS month_end, CASE WHEN amount >= 1 THEN amount END AS turnover,
  abs(close - open) / abs(open) * 1e4 AS bps, year(trade_date) || 'Q' || quarter(trade_date) AS quarter FROM bars""")
def _(fx):
    d = F.col("trade_date")
    return fx("bars").select(
        *KEY, M.lots_to_shares(F.col("volume")).alias("shares"), M.week_start(d).alias("week_start"), M.month_start(d).alias("month_start"), F.last_day(d).alias("month_end"),
        M.safe_turnover(F.col("amount")).alias("turnover"), M.relative_bps(F.col("close"), F.col("open")).alias("bps"), M.quarter_label(d).alias("quarter"),
    )


@query("f8_limit_thresholds", "status", "SELECT DISTINCT symbol, risk_warning, CASE WHEN coalesce(risk_warning, false) THEN 0.045 WHEN symbol LIKE '%.BJ' THEN 0.295 WHEN symbol LIKE '30%' OR symbol LIKE '688%' THEN 0.195 ELSE 0.095 END::DOUBLE AS threshold FROM status")
def _(fx):
    return fx("status").select("symbol", "risk_warning", S.limit_threshold(F.col("symbol"), F.col("risk_warning")).alias("threshold")).distinct()


@query("f9_keyword_sentiment", "announcements", f"SELECT announcement_id, round({_sentiment_sql('title')}, 9) AS score FROM announcements")
def _(fx):
    return fx("announcements").select("announcement_id", F.round(T.keyword_sentiment(F.col("title"), POSITIVE, NEGATIVE), 9).alias("score"))


@query("f11_related_symbols", "headlines", "SELECT news_id, upper(trim(u.x)) AS symbol FROM headlines, unnest(regexp_split_to_array(related_symbols, '[;,]')) u(x) WHERE regexp_full_match(upper(trim(u.x)), '[0-9]{6}\\.(SH|SZ)')")
def _(fx):
    return fx("headlines").select("news_id", F.explode(T.related_symbols(F.col("related_symbols"))).alias("symbol"))


@query("f14_ex_reference", "bars actions", "SELECT b.symbol, b.trade_date, a.action_type, (b.close - a.cash_dividend + 0.0) / (1 + a.bonus_ratio + 0.0 + 0.0) AS reference FROM bars b JOIN actions a ON b.symbol = a.symbol AND b.trade_date = a.ex_date")
def _(fx):
    a = fx("actions").withColumnRenamed("ex_date", "trade_date")
    ref = M.ex_reference(*(F.col(c) for c in ("close", "cash_dividend", "bonus_ratio", "transfer_ratio", "allotment_ratio", "allotment_price")))
    return fx("bars").join(a, KEY).select(*KEY, "action_type", ref.alias("reference"))


@query("f16_revision_id", "facts", """SELECT symbol, report_period, data_version,
  sha256(CAST(to_json({'announce_date': announce_date, 'item_code': item_code, 'item_value': item_value, 'report_period': report_period, 'symbol': symbol}) AS VARCHAR)) AS revision_id FROM facts""")
def _(fx):
    return fx("facts").select("symbol", "report_period", "data_version", M.revision_id(["symbol", "report_period", "item_code", "item_value", "announce_date"]).alias("revision_id"))


@query("f21_elapsed_fraction", "bars", "SELECT DISTINCT strftime(trade_date, '%Y-%m') AS label, least(1.0, greatest(0.0, (date_diff('day', CAST(date_trunc('month', trade_date) AS DATE), DATE '1998-06-10') + 1) / (date_diff('day', CAST(date_trunc('month', trade_date) AS DATE), last_day(trade_date)) + 1)))::DOUBLE AS elapsed FROM bars")
def _(fx):
    d = F.col("trade_date")
    return fx("bars").select(M.partition_value(d, "month").alias("label"), M.elapsed_fraction(M.month_start(d), F.last_day(d), F.lit("1998-06-10").cast("date")).alias("elapsed")).distinct()


@query("p8_placeholder_prices", "bars_raw", "SELECT symbol, trade_date, source FROM bars_raw WHERE open > 0 AND high > 0 AND low > 0 AND close > 0")
def _(fx):
    return fx("bars_raw").where(M.placeholder_free()).select(*KEY, "source")


@query("p13_session_rows", "bars calendar", "SELECT b.symbol, b.trade_date FROM bars b JOIN calendar c ON b.trade_date = c.trade_date WHERE c.is_trading")
def _(fx):
    return fx("bars").join(F.broadcast(fx("calendar").where("is_trading")), "trade_date", "left_semi").select(*KEY)


@query("p15_instrument_search", "instruments", "SELECT symbol, name FROM instruments WHERE (contains(lower(symbol), 'st') OR contains(lower(name), 'st')) AND exchange = 'SZ' AND (list_date IS NULL OR list_date <= DATE '2000-01-01') AND (delist_date IS NULL OR delist_date >= DATE '2000-01-01')")
def _(fx):
    return paging.search_instruments(fx("instruments"), "ST", "SZ", as_of="2000-01-01").select("symbol", "name")


@query("p16_resolve_symbol", "instruments", "SELECT symbol, name, delist_date IS NOT NULL AS is_delisted FROM instruments WHERE symbol LIKE '60%' OR contains(lower(name), '60')")
def _(fx):
    return paging.resolve_symbol(fx("instruments"), "60")


@query("p17_status_page", "status", "SELECT symbol, trade_date, status, source FROM status WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND status = 'suspended' AND NOT is_trading")
def _(fx):
    return fx("status").where(F.col("trade_date").between("1999-01-01", "1999-12-31") & (F.col("status") == "suspended") & ~F.col("is_trading")).select(*KEY, "status", "source")


@query("t2_keyset_page", "instruments", "SELECT symbol, name FROM instruments WHERE symbol > '300006.SZ' ORDER BY symbol LIMIT 21")
def _(fx):
    return paging.keyset_page(fx("instruments").select("symbol", "name"), "symbol", "300006.SZ", 20)


@query("t3_offset_page", "bars_raw", "SELECT symbol, trade_date, close FROM bars_raw WHERE source = 'tdx_protocol' ORDER BY trade_date, symbol LIMIT 100 OFFSET 50")
def _(fx):
    return paging.offset_page(fx("bars_raw").where("source = 'tdx_protocol'"), ["trade_date", "symbol"], 100, 50)[0].select(*KEY, "close")


@query("t4_latest_row", "bars_raw", "SELECT symbol, max(trade_date) AS trade_date, max_by(fetched_at, (trade_date, fetched_at)) AS fetched_at FROM bars_raw GROUP BY 1")
def _(fx):
    return paging.latest_per(fx("bars_raw"), "symbol", "trade_date").select("symbol", "trade_date", "fetched_at")


@query("t5_most_traded", "bars", "SELECT symbol, trade_date, amount FROM bars WHERE trade_date = DATE '1998-06-15' ORDER BY amount DESC, symbol LIMIT 12")
def _(fx):
    return paging.most_traded(fx("bars"), "1998-06-15", 12).select(*KEY, "amount")


@query("u3_symbol_sets", "bars valuations", "SELECT symbol, 'both' AS side FROM (SELECT symbol FROM bars INTERSECT SELECT symbol FROM valuations) a UNION ALL SELECT symbol, 'valuations' FROM (SELECT symbol FROM valuations EXCEPT SELECT symbol FROM bars) b")
def _(fx):
    b, v = fx("bars").select("symbol"), fx("valuations").select("symbol")
    return b.intersect(v).select("symbol", F.lit("both").alias("side")).unionByName(v.subtract(b).select("symbol", F.lit("valuations").alias("side")))


@query("a16_filtered_aggregates", "bars instruments", """
SELECT b.symbol, count(*) FILTER (b.volume > 20) AS n_large, round(avg(b.close) FILTER (b.volume > 20), 8) AS avg_large, min_by(b.close, b.trade_date) AS first_close, max_by(b.close, b.trade_date) AS last_close, bool_and(b.close > 0) AS all_positive FROM bars b GROUP BY 1""")
def _(fx):
    large = F.col("volume") > 20
    return fx("bars").groupBy("symbol").agg(
        F.count_if(large).alias("n_large"), F.round(F.avg(F.when(large, F.col("close"))), 8).alias("avg_large"), F.min_by("close", "trade_date").alias("first_close"), F.max_by("close", "trade_date").alias("last_close"), F.bool_and(F.col("close") > 0).alias("all_positive")
    )
