"""Queries of the core operators: canonical rows, adjustment, as-of joins, point in time, universes, bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as S
from ..operators import adjust, asof, bars, canonical, pit, universe
from .core import query

KEY = ["symbol", "trade_date"]
SOURCES = {"primary": "tdx_protocol", "backup": "baostock"}
CANON = """canon AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY fetched_at DESC NULLS LAST,
  CASE source WHEN 'tdx_protocol' THEN 2 WHEN 'baostock' THEN 1 ELSE 0 END DESC, source DESC, data_version DESC) AS rn FROM bars_raw) x WHERE rn = 1)"""
HFQ = """adj AS (SELECT b.*, coalesce(f.factor, 1.0) AS factor, f.factor IS NOT NULL AS adj_is_exact FROM bars b LEFT JOIN factors f ON b.symbol = f.symbol AND b.trade_date = f.trade_date)"""
CODE, EX = "split_part({0}, '.', 1)", "split_part({0}, '.', 2)"


def universe_sql(symbol: str, sh_sz: bool = False) -> str:
    c, e = CODE.format(symbol), EX.format(symbol)
    two = f"left({c}, 2)"
    bj = "" if sh_sz else f" OR ({e} = 'BJ' AND {two} IN ('92', '43', '83', '87'))"
    return (
        f"((({e} = 'SH' AND {two} IN ('60', '68')) OR ({e} = 'SZ' AND {two} IN ('00', '30')){bj}) AND NOT ({e} IN ('SH', 'SZ') AND {two} BETWEEN '81' AND '89')"
        f" AND NOT ({e} = 'SH' AND left({c}, 3) = '689') AND NOT {etf_sql(symbol)})"
    )


def etf_sql(symbol: str) -> str:
    c, e = CODE.format(symbol), EX.format(symbol)
    return f"(({e} = 'SH' AND left({c}, 2) IN ('51', '52', '56', '58')) OR ({e} = 'SZ' AND left({c}, 2) IN ('15', '16')))"


def excluded_sql(a: str = "") -> str:
    return f"(coalesce({a}status IN ('suspended', 'delisted', 'not_listed', 'st', '*st'), false) OR coalesce({a}risk_warning, false))"


@query("a1_canonical_rows", "bars_raw", f"WITH {CANON} SELECT symbol, trade_date, close, volume, source FROM canon")
def _(fx):
    return canonical.canonical(fx("bars_raw"), KEY, **SOURCES).select(*KEY, "close", "volume", "source")


@query("a1_status_evidence", "status", """
SELECT symbol, trade_date, status, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY
  CASE WHEN source = 'eastmoney_cached' THEN 0 WHEN source IN ('eastmoney', 'tdx_protocol') AND CAST(fetched_at + INTERVAL 8 HOUR AS DATE) = trade_date AND hour(fetched_at + INTERVAL 8 HOUR) >= 15 THEN 2
    WHEN source IN ('eastmoney', 'tdx_protocol') THEN 0 WHEN source = 'derived_bar_gap' THEN 1 ELSE 2 END DESC, fetched_at DESC NULLS LAST, source DESC, data_version DESC) AS rn FROM status) x WHERE rn = 1""")
def _(fx):
    return canonical.canonical(fx("status"), KEY, evidence=True).select(*KEY, "status", "source")


@query("s6_traded_rows", "bars_raw", f"WITH {CANON} SELECT symbol, trade_date, close, volume FROM canon WHERE volume > 0 OR volume IS NULL")
def _(fx):
    return canonical.traded_rows(fx("bars_raw"), KEY, **SOURCES).select(*KEY, "close", "volume")


@query("u5_upsert", "bars bars_raw", """
WITH u AS (SELECT symbol, trade_date, close, volume, 'tdx_protocol' AS source, 'v0' AS data_version, CAST(trade_date AS TIMESTAMP) AS fetched_at FROM bars
  UNION ALL SELECT symbol, trade_date, close, volume, source, data_version, fetched_at FROM bars_raw WHERE source = 'baostock')
SELECT symbol, trade_date, close, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY fetched_at DESC, CASE source WHEN 'tdx_protocol' THEN 2 ELSE 1 END DESC) AS rn FROM u) x WHERE rn = 1""")
def _(fx):
    stored = fx("bars").select(*KEY, "close", "volume", F.lit("tdx_protocol").alias("source"), F.lit("v0").alias("data_version"), F.col("trade_date").cast("timestamp").alias("fetched_at"))
    incoming = fx("bars_raw").where("source = 'baostock'").select(stored.columns)
    return canonical.upsert(stored, incoming, KEY, **SOURCES).select(*KEY, "close", "source")


@query("a19_duplicate_keys", "bars_raw", "SELECT symbol, trade_date, count(*) AS n_rows FROM bars_raw GROUP BY ALL HAVING count(*) > 1")
def _(fx):
    return canonical.duplicate_keys(fx("bars_raw"), KEY)


#: Prices and amounts as decimals, whose texts are the same in both engines.
RESOLVED = {"open": "decimal(24,9)", "high": "decimal(24,9)", "low": "decimal(24,9)", "close": "decimal(24,9)", "amount": "decimal(24,2)"}
_DIGESTED = " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for c in ("amount", "close", "high", "low", "open", "symbol", "trade_date", "volume") for t in [f"CAST({f'CAST({c} AS {RESOLVED[c]})' if c in RESOLVED else c} AS VARCHAR)"])


@query("a22_business_digest", "bars_raw", f"""
WITH h AS (SELECT md5({_DIGESTED}) AS h FROM bars_raw)
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS digest_a, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS digest_b FROM h""")
def _(fx):
    resolved = fx("bars_raw").withColumns({c: F.col(c).cast(t) for c, t in RESOLVED.items()})
    return canonical.business_digest(resolved).select("n_rows", F.col("digest_a").cast("string").alias("digest_a"), F.col("digest_b").cast("string").alias("digest_b"))


@query("t6_stratified_sample", "bars", """
SELECT exchange, symbol, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY md5(symbol || '|' || CAST(trade_date AS VARCHAR)), symbol, trade_date) AS rn
  FROM (SELECT symbol, trade_date, split_part(symbol, '.', 2) AS exchange FROM bars) b) x WHERE rn <= 50""")
def _(fx):
    rows = fx("bars").select(*KEY, S.exchange(F.col("symbol")).alias("exchange"))
    return canonical.stratified_sample(rows, "exchange", KEY, 50).select("exchange", *KEY)


@query("j2_hfq_adjust", "bars factors", f"WITH {HFQ} SELECT symbol, trade_date, factor, adj_is_exact, open * factor AS adj_open, close * factor AS adj_close FROM adj")
def _(fx):
    return adjust.hfq(fx("bars"), fx("factors")).select(*KEY, "factor", "adj_is_exact", "adj_open", "adj_close")


QFQ = """, anchor AS (SELECT f.symbol, max_by(f.factor, f.trade_date) AS anchor FROM {f} f JOIN (SELECT symbol, max(trade_date) AS last FROM {b} GROUP BY symbol) l ON f.symbol = l.symbol AND f.trade_date <= l.last GROUP BY f.symbol),
q AS (SELECT a.symbol, a.trade_date, a.adj_is_exact, a.close, CASE WHEN a.adj_is_exact AND n.anchor <> 0 THEN a.factor / n.anchor ELSE 1.0 END AS qfq_factor, a.factor FROM adj a LEFT JOIN anchor n ON a.symbol = n.symbol)"""
IN_SCOPE = "trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


@query("j3_qfq_in_scope", "bars factors", f"""WITH b AS (SELECT * FROM bars WHERE {IN_SCOPE}), f AS (SELECT * FROM factors WHERE {IN_SCOPE}), {HFQ.replace('FROM bars b', 'FROM b').replace('factors f', 'f')}{QFQ.format(f='f', b='b')}
SELECT symbol, trade_date, adj_is_exact, qfq_factor, close * qfq_factor AS adj_close FROM q""")
def _(fx):
    return adjust.qfq_in_scope(fx("bars"), fx("factors"), "1996-01-01", "1998-12-31").select(*KEY, "adj_is_exact", "qfq_factor", "adj_close")


@query("j3_qfq_whole_lake", "bars factors", f"WITH {HFQ}{QFQ.format(f='factors', b='bars')} SELECT symbol, trade_date, adj_is_exact, qfq_factor, close * qfq_factor AS adj_close FROM q")
def _(fx):
    return adjust.qfq_whole_lake(fx("bars"), fx("factors")).select(*KEY, "adj_is_exact", "qfq_factor", "adj_close")


@query("s10_daily_bars_adj", "bars factors", f"WITH {HFQ}{QFQ.format(f='factors', b='bars')} SELECT symbol, trade_date, close, close * factor AS hfq_close, close * qfq_factor AS qfq_close, close * qfq_factor AS adj_close, adj_is_exact FROM q")
def _(fx):
    return adjust.daily_bars_adj(fx("bars"), fx("factors")).select(*KEY, "close", "hfq_close", "qfq_close", "adj_close", "adj_is_exact")


@query("s11_daily_bars_qfq", "bars factors", f"""WITH b AS (SELECT * FROM bars WHERE {IN_SCOPE}), {HFQ.replace('FROM bars b', 'FROM b')}{QFQ.format(f='factors', b='b')}
SELECT symbol, trade_date, adj_is_exact, close * qfq_factor AS adj_close FROM q""")
def _(fx):
    return adjust.qfq_window(fx("bars"), fx("factors"), "1996-01-01", "1998-12-31").select(*KEY, "adj_is_exact", "adj_close")


@query("j18_qfq_base_date", "bars factors", f"""WITH {HFQ}, base AS (SELECT symbol, factor AS base FROM factors WHERE trade_date = DATE '1998-06-15'),
q AS (SELECT a.*, coalesce(a.adj_is_exact AND b.base > 0, false) AS exact, b.base FROM adj a LEFT JOIN base b ON a.symbol = b.symbol)
SELECT symbol, trade_date, exact AS adj_is_exact, CASE WHEN exact THEN factor / base ELSE 1.0 END AS qfq_factor, close * CASE WHEN exact THEN factor / base ELSE 1.0 END AS adj_close FROM q""")
def _(fx):
    return adjust.qfq_base_date(fx("bars"), fx("factors"), "1998-06-15").select(*KEY, "adj_is_exact", "qfq_factor", "adj_close")


@query("d25_factor_page", "factors", "WITH s AS (SELECT * FROM factors WHERE factor > 0 AND isfinite(factor)) SELECT s.symbol, s.trade_date, s.factor / b.factor AS factor FROM s JOIN (SELECT * FROM s WHERE trade_date = DATE '1998-06-15') b ON s.symbol = b.symbol")
def _(fx):
    return adjust.factor_page(fx("factors"), "1998-06-15").select(*KEY, "factor")


@query("j7_asof_step", "bars factor_events", """
SELECT b.symbol, b.trade_date, coalesce((SELECT max_by(e.factor, e.ex_date) FROM factor_events e WHERE e.symbol = b.symbol AND e.ex_date <= b.trade_date), 1.0) AS factor FROM bars b""")
def _(fx):
    return asof.asof_step(fx("bars").select(*KEY), fx("factor_events"), "symbol", "trade_date", "ex_date", "factor", 1.0).select(*KEY, "factor")


@query("j8_members_as_of", "bars members", """
WITH days AS (SELECT DISTINCT trade_date FROM bars), snap AS (SELECT d.trade_date, max(m.as_of_date) AS as_of_date FROM days d JOIN (SELECT DISTINCT as_of_date FROM members) m ON m.as_of_date <= d.trade_date GROUP BY d.trade_date)
SELECT m.symbol, s.trade_date, m.industry_code FROM members m JOIN snap s ON m.as_of_date = s.as_of_date""")
def _(fx):
    return asof.members_as_of(fx("bars").select("trade_date"), "trade_date", fx("members")).select(*KEY, "industry_code")


@query("j10_expand_open", "intervals month_ends", """
SELECT symbol, industry_code, as_of_date FROM (SELECT i.symbol, i.industry_code, m.as_of_date, row_number() OVER (PARTITION BY i.symbol, m.as_of_date ORDER BY i.start_date DESC) AS rn
  FROM intervals i JOIN month_ends m ON i.start_date <= m.as_of_date) x WHERE rn = 1""")
def _(fx):
    return asof.expand_open(fx("intervals"), fx("month_ends"), "symbol", "start_date", "as_of_date").select("symbol", "industry_code", "as_of_date")


@query("j11_expand_closed_open", "intervals month_ends", "SELECT i.symbol, i.industry_code, m.as_of_date FROM intervals i JOIN month_ends m ON i.start_date <= m.as_of_date AND (i.end_date IS NULL OR m.as_of_date < i.end_date)")
def _(fx):
    return asof.expand_closed_open(fx("intervals"), fx("month_ends"), "start_date", "end_date", "as_of_date").select("symbol", "industry_code", "as_of_date")


@query("j12_expected_minus_bars", "bars sessions spans", "SELECT p.symbol, s.trade_date FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar ANTI JOIN bars b ON b.symbol = p.symbol AND b.trade_date = s.trade_date")
def _(fx):
    want = asof.expected_sessions(bars.spans(fx("bars")), fx("sessions"), "first_bar", "last_bar").select(*KEY)
    return want.join(fx("bars").select(*KEY), KEY, "left_anti")


@query("j13_previous_session", "bars sessions", "SELECT t.symbol, t.trade_date, t.close, p.close AS prev_close FROM bars t JOIN sessions s ON t.trade_date = s.trade_date JOIN bars p ON p.symbol = t.symbol AND p.trade_date = s.prev_date WHERE t.volume > 0")
def _(fx):
    return bars.previous_session(fx("bars"), fx("sessions")).select(*KEY, "close", "prev_close")


@query("j19_latest_snapshot", "members", "SELECT symbol, industry_code, as_of_date FROM members WHERE as_of_date = (SELECT max(as_of_date) FROM members)")
def _(fx):
    return asof.latest_snapshot(fx("members"), "as_of_date").select("symbol", "industry_code", "as_of_date")


@query("j20_session_neighbours", "sessions", "SELECT trade_date, prev_date, next_date FROM sessions")
def _(fx):
    return asof.with_neighbours(fx("sessions").select("trade_date"))


@query("j23_ever_traded", "bars_raw", "SELECT symbol, trade_date, source, volume FROM bars_raw SEMI JOIN (SELECT DISTINCT symbol FROM bars_raw WHERE volume > 0 OR volume IS NULL) t USING (symbol)")
def _(fx):
    return universe.ever_traded(fx("bars_raw")).select(*KEY, "source", "volume")


@query("s19_window_with_previous", "members", "SELECT symbol, as_of_date FROM members WHERE as_of_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' OR as_of_date = (SELECT max(as_of_date) FROM members WHERE as_of_date < DATE '1998-01-01')")
def _(fx):
    return asof.window_with_previous(fx("members"), "as_of_date", "1998-01-01", "2000-12-31").select("symbol", "as_of_date")


PIT = """v AS (SELECT *, announce_date <= DATE '1999-06-30' AS visible, CAST(fetched_at AS DATE) <= DATE '1999-06-30' AS in_time, regexp_matches(lower(source), 'backfill|reconstruct|snapshot') AS rebuilt FROM facts)"""
FACT_KEY = ["symbol", "report_period", "statement_type", "item_code", "announce_date"]


@query("p9_pit_strict", "facts", f"WITH {PIT} SELECT symbol, report_period, item_code, announce_date, item_value FROM v WHERE visible AND NOT rebuilt AND in_time")
def _(fx):
    return pit.classify(fx("facts"), "1999-06-30", "strict").select("symbol", "report_period", "item_code", "announce_date", "item_value")


@query("p9_pit_best_effort", "facts", f"WITH {PIT} SELECT symbol, report_period, announce_date, item_value, (NOT rebuilt AND in_time) AS pit_is_exact, CASE WHEN NOT rebuilt AND in_time THEN 'strict' ELSE 'reconstructed' END AS pit_quality FROM v WHERE visible")
def _(fx):
    return pit.classify(fx("facts"), "1999-06-30").select("symbol", "report_period", "announce_date", "item_value", "pit_is_exact", "pit_quality")


@query("a2_latest_vintage", "facts", f"""WITH {PIT} SELECT symbol, report_period, item_code, announce_date, item_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, report_period, statement_type, item_code
  ORDER BY announce_date DESC NULLS LAST, fetched_at DESC NULLS LAST, data_version DESC) AS rn FROM v WHERE visible AND in_time) x WHERE rn = 1""")
def _(fx):
    return pit.read_pit(fx("facts"), FACT_KEY, "1999-06-30", legacy_cutoff=True).select("symbol", "report_period", "item_code", "announce_date", "item_value")


@query("p2_pit_period_items", "facts", f"""WITH {PIT} SELECT symbol, report_period, item_code, item_value FROM v WHERE visible AND item_code IN ('item0', 'item2') AND report_period BETWEEN '1996Q1' AND '1997Q4'""")
def _(fx):
    return pit.read_pit(fx("facts"), FACT_KEY, "1999-06-30", ["item0", "item2"], True, "1996-01-15", "1997-12-31").select("symbol", "report_period", "item_code", "item_value")


LISTED = f"listed AS (SELECT b.* FROM bars b JOIN instruments i ON b.symbol = i.symbol WHERE {universe_sql('b.symbol')} AND (i.list_date IS NULL OR i.list_date <= b.trade_date) AND (i.delist_date IS NULL OR b.trade_date <= i.delist_date))"


@query("j4_universe_listed", "bars instruments", f"WITH {LISTED} SELECT symbol, trade_date, close FROM listed")
def _(fx):
    return universe.listed(fx("bars"), fx("instruments")).select(*KEY, "close")


@query("j5_universe_filter", "bars instruments status", f"WITH {LISTED} SELECT l.symbol, l.trade_date, l.close FROM listed l ANTI JOIN (SELECT * FROM status WHERE {excluded_sql()}) s ON s.symbol = l.symbol AND s.trade_date = l.trade_date")
def _(fx):
    return universe.apply_universe(fx("bars"), fx("instruments"), fx("status")).select(*KEY, "close")


@query("j6_uncovered_pairs", "bars status", "SELECT DISTINCT b.symbol, b.trade_date FROM bars b ANTI JOIN status s ON s.symbol = b.symbol AND s.trade_date = b.trade_date")
def _(fx):
    return universe.uncovered(fx("bars"), fx("status"))


@query("d32_tradable_on", "instruments status", f"""SELECT symbol FROM instruments i WHERE {universe_sql('i.symbol', True)} AND (list_date IS NULL OR list_date <= DATE '1998-06-15') AND (delist_date IS NULL OR DATE '1998-06-15' <= delist_date)
  AND symbol NOT IN (SELECT symbol FROM status WHERE trade_date = DATE '1998-06-15' AND {excluded_sql()})""")
def _(fx):
    return universe.tradable_on(fx("instruments"), fx("status"), "1998-06-15", "all_a_sh_sz")


@query("d31_scope_hash", "instruments", "SELECT count(*) AS n_symbols, CAST(sum(CAST(('0x' || substring(md5(symbol), 1, 15)) AS BIGINT)) AS VARCHAR) AS scope_hash FROM (SELECT DISTINCT symbol FROM instruments) s")
def _(fx):
    return universe.scope_hash(fx("instruments"))


def _period_sql(unit: str) -> str:
    return f"""WITH {HFQ}, a AS (SELECT symbol, trade_date, open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close, volume, amount, factor, adj_is_exact FROM adj)
SELECT symbol, CAST(date_trunc('{unit}', trade_date) AS DATE) AS period_start, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS n_bars, min_by(open, trade_date) AS open, max(high) AS high, min(low) AS low,
  max_by(close, trade_date) AS close, CAST(sum(volume) AS BIGINT) AS volume, round(sum(amount), 2) AS amount, max_by(factor, trade_date) AS factor, bool_and(adj_is_exact) AS adj_is_exact FROM a GROUP BY 1, 2"""


def _period(fx, unit):
    a = adjust.hfq(fx("bars"), fx("factors"))
    a = a.select(*KEY, *(F.col(f"adj_{c}").alias(c) for c in adjust.PRICES), "volume", "amount", "factor", "adj_is_exact")
    return bars.period_bars(a, unit).withColumn("amount", F.round("amount", 2))


@query("a3_weekly_bars", "bars factors", _period_sql("week"))
def _(fx):
    return _period(fx, "week")


@query("a3_monthly_bars", "bars factors", _period_sql("month"))
def _(fx):
    return _period(fx, "month")


@query("a4_upsample_15m", "minute_bars", """
SELECT symbol, trade_date, time_bucket(INTERVAL 15 MINUTE, bar_time - INTERVAL 1 MICROSECOND) + INTERVAL 15 MINUTE AS bar_end, min_by(open, bar_time) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_time) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, round(sum(amount), 2) AS amount, count(*) AS n_bars FROM minute_bars GROUP BY 1, 2, 3""")
def _(fx):
    return bars.upsample(fx("minute_bars"), 15).withColumn("amount", F.round("amount", 2))


RET = """lagged AS (SELECT *, lag(close) OVER w AS pp, lag(trade_date) OVER w AS pd FROM bars WHERE volume > 0 OR volume IS NULL WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
rets AS (SELECT l.*, l.close / l.pp - 1 AS ret FROM lagged l JOIN sessions s ON l.trade_date = s.trade_date AND l.pd = s.prev_date WHERE l.pp <> 0)"""


@query("w2_session_returns", "bars sessions", f"WITH {RET} SELECT symbol, trade_date, ret FROM rets")
def _(fx):
    return bars.session_returns(fx("bars"), fx("sessions")).select(*KEY, "ret")


@query("w5_raw_and_adjusted_returns", "bars factors", f"""WITH {HFQ} SELECT * FROM (SELECT symbol, trade_date, lag(trade_date) OVER w AS prev_date, close / lag(close) OVER w - 1 AS raw_ret, (close * factor) / lag(close * factor) OVER w - 1 AS adj_ret
  FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) x WHERE prev_date IS NOT NULL""")
def _(fx):
    return bars.raw_and_adjusted_returns(adjust.with_hfq(fx("bars"), fx("factors")))


@query("w6_tail_60", "bars", "SELECT symbol, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars) x WHERE rn <= 60")
def _(fx):
    return bars.tail(fx("bars"), 60).select(*KEY, "close")


@query("w8_cumulative_return", "bars", "SELECT symbol, trade_date, close / first(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS cum_ret FROM bars")
def _(fx):
    return bars.cumulative_return(fx("bars"), "close").select(*KEY, "cum_ret")


@query("w9_own_percentile", "bars", "SELECT symbol, trade_date, percent_rank() OVER (PARTITION BY symbol ORDER BY close) AS pct_rank FROM bars")
def _(fx):
    return bars.own_history_percentile(fx("bars"), "close").select(*KEY, "pct_rank")


@query("a6_group_returns", "bars sessions", f"WITH {RET} SELECT trade_date, split_part(symbol, '.', 2) AS exchange, round(avg(ret), 8) AS equal_ret, round(sum(ret * amount) / sum(amount), 8) AS amount_ret, count(DISTINCT symbol) AS n_symbols FROM rets GROUP BY 1, 2")
def _(fx):
    rets = bars.session_returns(fx("bars"), fx("sessions")).withColumn("exchange", S.exchange(F.col("symbol")))
    return bars.group_returns(rets, ["trade_date", "exchange"]).withColumn("equal_ret", F.round("equal_ret", 8)).withColumn("amount_ret", F.round("amount_ret", 8))


@query("a9_spans", "bars", "SELECT symbol, min(trade_date) AS first_bar, max(trade_date) AS last_bar, count(DISTINCT trade_date) AS n_dates FROM bars GROUP BY symbol")
def _(fx):
    return bars.spans(fx("bars"))


EXPECTED = "expected AS (SELECT p.symbol, s.trade_date FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar), cells AS (SELECT e.*, b.symbol IS NOT NULL AS there FROM expected e LEFT JOIN bars b ON b.symbol = e.symbol AND b.trade_date = e.trade_date)"


@query("w10_contiguous_prefix", "bars sessions spans", f"WITH {EXPECTED}, run AS (SELECT *, sum(CASE WHEN there THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY trade_date) AS holes FROM cells) SELECT symbol, max(CASE WHEN holes = 0 THEN trade_date END) AS last_contiguous FROM run GROUP BY symbol")
def _(fx):
    want = asof.expected_sessions(bars.spans(fx("bars")), fx("sessions"), "first_bar", "last_bar")
    return bars.contiguous_prefix(want, fx("bars"), ["symbol"])


@query("w11_gap_runs", "bars sessions spans", f"""WITH {EXPECTED}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM cells), m AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS island FROM n WHERE NOT there)
SELECT symbol, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS n_missing FROM m GROUP BY symbol, island""")
def _(fx):
    want = asof.expected_sessions(bars.spans(fx("bars")), fx("sessions"), "first_bar", "last_bar")
    return bars.gap_runs(want, fx("bars"), ["symbol"])
