"""Queries of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjust
from ..plans import derive as D
from ..plans import quality as Q
from .core import query
from .derived import INDEX
from .operators import HFQ, KEY, etf_sql


@query("q1_contract_violations", "bars_raw", """
WITH c AS (SELECT count(*) AS n_rows, count(*) FILTER (symbol IS NULL OR trim(symbol) = '') AS blank_symbol, count(*) FILTER (amount IS NULL) AS blank_amount, count(*) FILTER (source = 'mock') AS mock_rows,
  count(*) FILTER (NOT isfinite(open)) AS not_finite_open, count(*) FILTER (NOT isfinite(high)) AS not_finite_high, count(*) FILTER (NOT isfinite(low)) AS not_finite_low, count(*) FILTER (NOT isfinite(close)) AS not_finite_close, count(*) FILTER (NOT isfinite(amount)) AS not_finite_amount,
  count(*) FILTER (NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND coalesce(volume, 0) >= 0 AND coalesce(amount, 0) >= 0 AND (NOT (volume > 0 OR volume IS NULL) OR (high >= greatest(open, close, low) AND low <= least(open, close, high))), false)) AS invalid_bars FROM bars_raw)
SELECT rule, n FROM c UNPIVOT (n FOR rule IN (n_rows, blank_symbol, blank_amount, mock_rows, not_finite_open, not_finite_high, not_finite_low, not_finite_close, not_finite_amount, invalid_bars))""")
def _(fx):
    return Q.contract_violations(fx("bars_raw"), ["symbol", "amount"])


def _mutation_sql(rows: str) -> str:
    return f"""
WITH p AS (SELECT strftime(trade_date, '%Y-%m') AS period, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM {rows} GROUP BY 1),
l AS (SELECT *, lag(n_rows) OVER (ORDER BY period) AS prev_rows, lag(n_symbols) OVER (ORDER BY period) AS prev_symbols FROM p) SELECT * FROM l WHERE prev_rows >= 50 AND (n_rows < 0.8 * prev_rows OR n_symbols < 0.8 * prev_symbols)"""


@query("q4_row_mutation", "bars", _mutation_sql("bars"))
def _(fx):
    return Q.row_mutation(fx("bars"), F.date_format("trade_date", "yyyy-MM"), ratio=0.8)


@query("q4_row_mutation_planted", "thinned_bars", _mutation_sql("thinned_bars"))
def _(fx):
    return Q.row_mutation(fx("thinned_bars"), F.date_format("trade_date", "yyyy-MM"), ratio=0.8)


@query("q5_fragmentation", "bars", """
WITH f AS (SELECT split_part(symbol, '.', 2) AS dataset, trade_date AS partition, count(*) AS n FROM bars GROUP BY 1, 2) SELECT dataset, count(DISTINCT partition) AS n_partitions, CAST(sum(n) AS BIGINT) AS n_rows FROM f GROUP BY 1 HAVING count(DISTINCT partition) >= 30 AND sum(n) < 50 * count(DISTINCT partition)""")
def _(fx):
    return Q.fragmentation(fx("bars").groupBy(F.substring_index("symbol", ".", -1).alias("dataset"), F.col("trade_date").alias("partition")).agg(F.count("*").alias("n_rows")))


def _mismatch_sql(rows: str) -> str:
    return f"SELECT DISTINCT b.trade_date, 'orphan' AS problem FROM {rows} b ANTI JOIN sessions s ON b.trade_date = s.trade_date UNION ALL SELECT s.trade_date, 'missing_day' FROM sessions s ANTI JOIN {rows} b ON b.trade_date = s.trade_date"


@query("q6_calendar_mismatch", "bars sessions", _mismatch_sql("bars"))
def _(fx):
    return Q.calendar_mismatch(fx("bars"), fx("sessions"))


@query("q6_calendar_mismatch_planted", "large_bars sessions", _mismatch_sql("large_bars"))
def _(fx):
    return Q.calendar_mismatch(fx("large_bars"), fx("sessions"))


@query("q7_calendar_horizon", "calendar", "SELECT trade_date FROM calendar WHERE trade_date > DATE '2001-06-30'")
def _(fx):
    return Q.calendar_horizon(fx("calendar"), "2001-06-30")


@query("q8_session_coverage", "bars sessions spans", """
WITH m AS (SELECT p.symbol, count(*) AS n FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar ANTI JOIN bars b ON b.symbol = p.symbol AND b.trade_date = s.trade_date GROUP BY 1), o AS (SELECT b.symbol, count(*) AS n FROM bars b ANTI JOIN sessions s ON b.trade_date = s.trade_date GROUP BY 1)
SELECT coalesce(m.symbol, o.symbol) AS symbol, coalesce(m.n, 0) AS n_missing, coalesce(o.n, 0) AS n_orphan FROM m FULL JOIN o ON m.symbol = o.symbol""")
def _(fx):
    return Q.session_coverage(fx("bars"), fx("sessions"))


@query("q9_valuation_coverage", "valuations bars", """
WITH p AS (SELECT b.trade_date, count(*) AS n_bars, count(v.symbol) AS n_valued FROM bars b LEFT JOIN valuations v ON b.symbol = v.symbol AND b.trade_date = v.trade_date WHERE b.volume > 0 GROUP BY 1) SELECT *, n_valued / n_bars AS coverage FROM p WHERE n_valued / n_bars < 0.7""")
def _(fx):
    return Q.valuation_coverage(fx("valuations"), fx("bars"))


@query("q9_orphan_symbols", "valuations bars", "SELECT DISTINCT symbol FROM valuations WHERE symbol NOT IN (SELECT symbol FROM bars)")
def _(fx):
    return fx("valuations").select("symbol").distinct().join(fx("bars").select("symbol").distinct(), "symbol", "left_anti")


@query("q10_factor_coverage", "bars factors", """
WITH n AS (SELECT b.symbol, count(*) AS n FROM bars b ANTI JOIN factors f ON b.symbol = f.symbol AND b.trade_date = f.trade_date GROUP BY 1), p AS (SELECT split_part(s.symbol, '.', 2) AS exchange, count(*) AS n_symbols, count(*) FILTER (n.n IS NULL) AS n_covered FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN n ON s.symbol = n.symbol GROUP BY 1)
SELECT *, n_covered / n_symbols AS share FROM p WHERE n_covered / n_symbols < 0.98""")
def _(fx):
    return Q.factor_coverage(fx("bars"), fx("factors"))


RR = f"""{HFQ}, r AS (SELECT * FROM (SELECT symbol, trade_date, lag(trade_date) OVER w AS prev_date, close / lag(close) OVER w - 1 AS raw_ret, (close * factor) / lag(close * factor) OVER w - 1 AS adj_ret FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) x WHERE prev_date IS NOT NULL)"""


@query("q11_adjusted_breaks", "bars factors sessions", f"""WITH {RR}, b AS (SELECT r.*, abs(adj_ret - raw_ret) AS divergence FROM r JOIN sessions s ON r.trade_date = s.trade_date AND r.prev_date = s.prev_date WHERE abs(adj_ret) > 0.02 AND abs(adj_ret - raw_ret) > 0.01)
SELECT symbol, max(divergence) AS divergence, count(*) AS n_found, max_by(trade_date, (divergence, trade_date)) AS trade_date, max_by(adj_ret, (divergence, trade_date)) AS adj_ret, max_by(raw_ret, (divergence, trade_date)) AS raw_ret FROM b GROUP BY 1""")
def _(fx):
    both = adjust.with_hfq(fx("bars"), fx("factors"))
    r = Q.raw_and_adjusted_returns(both).join(F.broadcast(fx("sessions").select("trade_date", F.col("prev_date").alias("_p"))), "trade_date").where("prev_date = _p")
    bad = r.withColumn("divergence", F.abs(F.col("adj_ret") - F.col("raw_ret"))).where((F.abs("adj_ret") > 0.02) & (F.col("divergence") > 0.01))
    return Q.worst_per(bad, "symbol", "divergence", ["trade_date", "adj_ret", "raw_ret"])


@query("q11_adj_close_discontinuity", "bars factors sessions", f"""WITH {RR}, b AS (SELECT r.*, abs(adj_ret - raw_ret) AS divergence FROM r JOIN sessions s ON r.trade_date = s.trade_date AND r.prev_date = s.prev_date WHERE abs(adj_ret) > 0.35 AND abs(adj_ret - raw_ret) > 0.35)
SELECT symbol, max(divergence) AS divergence, count(*) AS n_found FROM b GROUP BY 1""")
def _(fx):
    return Q.adjusted_breaks(adjust.with_hfq(fx("bars"), fx("factors")), fx("sessions").select("trade_date")).select("symbol", "divergence", "n_found")


def _unexplained_sql(actions: str) -> str:
    return f"""WITH {RR} SELECT r.symbol, r.trade_date, r.prev_date, raw_ret, adj_ret, abs(adj_ret - raw_ret) AS divergence FROM r ANTI JOIN {actions} a ON a.symbol = r.symbol AND a.ex_date > r.prev_date AND a.ex_date <= r.trade_date
WHERE abs(adj_ret) <= 0.5 AND abs(adj_ret - raw_ret) > 0.005"""


def _unexplained(fx, actions):
    return Q.missing_actions(adjust.with_hfq(fx("bars"), fx("factors")), actions, 0.5, 0.005).select("symbol", "trade_date", "prev_date", "raw_ret", "adj_ret", "divergence")


@query("q12_missing_actions", "bars factors actions", _unexplained_sql("actions"))
def _(fx):
    return _unexplained(fx, fx("actions"))


@query("q12_missing_actions_planted", "bars factors few_actions", _unexplained_sql("few_actions"))
def _(fx):
    return _unexplained(fx, fx("few_actions"))


@query("q13_factor_steps", "factors", "WITH s AS (SELECT symbol, trade_date, factor / lag(factor) OVER (PARTITION BY symbol, adjust_type ORDER BY trade_date) AS step FROM factors) SELECT * FROM s WHERE step > 1.02 OR step < 1 / 1.02")
def _(fx):
    return Q.factor_steps(fx("factors"), 1.02).select("symbol", "trade_date", "step")


@query("q14_factor_crosscheck", "bars factors actions", f"""WITH {HFQ}, p AS (SELECT symbol, trade_date, factor, lag(factor) OVER w AS pf, lag(close) OVER w AS pc FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
t AS (SELECT symbol, ex_date, sum(cash_dividend) AS cash, sum(bonus_ratio) AS bonus FROM actions GROUP BY 1, 2),
x AS (SELECT p.symbol, p.trade_date, factor / pf AS actual, pc, (pc - cash + 0.0) / (1 + bonus + 0.0 + 0.0) AS ref FROM p JOIN t ON p.symbol = t.symbol AND p.trade_date = t.ex_date WHERE pf IS NOT NULL),
y AS (SELECT symbol, trade_date, actual, CASE WHEN ref <> 0 THEN pc / ref END AS expected, ref <= 0 AS degenerate FROM x)
SELECT symbol, trade_date, round(actual, 9) AS actual, round(expected, 9) AS expected, degenerate FROM y WHERE degenerate OR abs(actual - expected) / abs(expected) * 1e4 > 50""")
def _(fx):
    out = Q.factor_crosscheck(adjust.with_hfq(fx("bars"), fx("factors")), fx("actions"))
    return out.select("symbol", "trade_date", F.round("actual", 9).alias("actual"), F.round("expected", 9).alias("expected"), "degenerate")


def _survivor_sql(rows: str) -> str:
    return f"""
WITH l AS (SELECT symbol, max(trade_date) AS last_bar FROM {rows} GROUP BY 1) SELECT l.symbol, l.last_bar, i.delist_date IS NULL AS undated FROM l LEFT JOIN instruments i ON l.symbol = i.symbol WHERE date_diff('day', l.last_bar, (SELECT max(trade_date) FROM {rows})) > 5"""


@query("q15_survivorship", "bars instruments", _survivor_sql("bars"))
def _(fx):
    return Q.survivorship(fx("bars"), fx("instruments"), quiet_days=5)


@query("q15_survivorship_planted", "large_bars instruments", _survivor_sql("large_bars"))
def _(fx):
    return Q.survivorship(fx("large_bars"), fx("instruments"), quiet_days=5)


@query("q16_close_mismatch", "bars backup_bars", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS rn FROM bars) x WHERE rn <= 12) SELECT l.symbol, l.trade_date, l.close, b.close AS ref_close FROM l JOIN backup_bars b ON l.symbol = b.symbol AND l.trade_date = b.trade_date WHERE abs(l.close - b.close) > 0.001 * abs(b.close)""")
def _(fx):
    return Q.close_mismatch(fx("bars"), fx("backup_bars"))


@query("q17_st_labels", "status instruments", """
WITH l AS (SELECT symbol, max_by(coalesce(risk_warning, false), (trade_date, fetched_at, source)) AS labelled FROM status GROUP BY 1), n AS (SELECT symbol, coalesce(regexp_matches(name, '^\\*?ST'), false) AS named FROM instruments)
SELECT * FROM (SELECT coalesce(l.symbol, n.symbol) AS symbol, coalesce(labelled, false) AS labelled, coalesce(named, false) AS named FROM l FULL JOIN n ON l.symbol = n.symbol) x WHERE labelled <> named""")
def _(fx):
    return Q.st_labels(fx("status"), fx("instruments"))


@query("q18_volume_unit", "bars_raw", """
WITH p AS (SELECT source, median(amount / close / volume) AS m, count(*) AS n_rows FROM bars_raw WHERE volume > 0 GROUP BY 1 HAVING count(*) >= 200) SELECT source, round(m, 9) AS median_ratio, n_rows FROM p WHERE m < 0.9999 OR m > 1.0001""")
def _(fx):
    return Q.volume_unit(fx("bars_raw"), 0.9999, 1.0001).withColumn("median_ratio", F.round("median_ratio", 9))


@query("q19_amount_completeness", "bars_raw", "SELECT source, count(*) AS n_rows, count(*) FILTER (amount IS NULL) AS n_null, count(*) FILTER (amount IS NULL) / count(*) AS null_share FROM bars_raw GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (amount IS NULL) > 0")
def _(fx):
    return Q.amount_completeness(fx("bars_raw"))


@query("q20_off_session_bars", "minute_bars", """
SELECT trade_date, count(*) FILTER (NOT (strftime(bar_time, '%H:%M:%S') BETWEEN '09:31:00' AND '11:30:00' OR strftime(bar_time, '%H:%M:%S') BETWEEN '13:01:00' AND '15:00:00')) AS n_off, count(*) FILTER (CAST(bar_time AS DATE) <> trade_date) AS n_other_day FROM minute_bars GROUP BY 1 HAVING n_off + n_other_day > 0""")
def _(fx):
    return Q.off_session_bars(fx("minute_bars"))


@query("q21_short_sessions", "minute_bars", "WITH p AS (SELECT symbol, trade_date, count(*) AS n FROM minute_bars GROUP BY 1, 2) SELECT trade_date, count(*) AS n_symbols, count(*) FILTER (n < 0.9 * 240) AS n_short FROM p GROUP BY 1 HAVING count(*) FILTER (n < 0.9 * 240) >= 0.2 * count(*)")
def _(fx):
    return Q.short_sessions(fx("minute_bars"))


_RECON = "WITH t AS (SELECT symbol, trade_date, sum(volume) AS v, sum({a}) AS a FROM {f} GROUP BY 1, 2), p AS (SELECT t.trade_date, median(t.v / d.volume) AS volume_ratio, median(t.a / d.amount) AS amount_ratio, count(*) AS n FROM t JOIN tick_days d ON t.symbol = d.symbol AND t.trade_date = d.trade_date GROUP BY 1)"


@query("q22_minute_reconciliation", "minute_bars tick_days", _RECON.format(a="amount", f="minute_bars") + " SELECT trade_date, round(volume_ratio, 9) AS volume_ratio, round(amount_ratio, 6) AS amount_ratio, n FROM p WHERE n >= 20 AND (volume_ratio NOT BETWEEN 0.9999 AND 1.0 OR amount_ratio NOT BETWEEN 0.95 AND 1.05)")
def _(fx):
    out = Q.daily_reconciliation(fx("minute_bars"), fx("tick_days"), (0.9999, 1.0), (0.95, 1.05))
    return out.select("trade_date", F.round("volume_ratio", 9).alias("volume_ratio"), F.round("amount_ratio", 6).alias("amount_ratio"), "n")


def _gaps_sql(rows: str) -> str:
    return f"SELECT symbol, trade_date, min(tick_seq) AS lo, max(tick_seq) AS hi, count(*) AS n, count(DISTINCT tick_seq) AS n_distinct FROM {rows} GROUP BY 1, 2 HAVING lo <> 0 OR hi <> n - 1 OR n_distinct <> n"


@query("q23_tick_sequence_gaps", "ticks", _gaps_sql("ticks"))
def _(fx):
    return Q.tick_sequence_gaps(fx("ticks"))


@query("q23_tick_sequence_gaps_planted", "holed_ticks", _gaps_sql("holed_ticks"))
def _(fx):
    return Q.tick_sequence_gaps(fx("holed_ticks"))


_T = "strftime(trade_time, '%H:%M:%S')"


@query("q24_off_session_ticks", "ticks", f"""SELECT trade_date, count(*) FILTER (NOT ({_T} BETWEEN '09:25:00' AND '09:25:59' OR {_T} BETWEEN '09:30:00' AND '11:30:00' OR {_T} BETWEEN '13:00:00' AND '15:00:00' OR {_T} BETWEEN '15:05:00' AND '15:30:00')) AS n_off,
  count(*) FILTER (CAST(trade_time AS DATE) <> trade_date) AS n_other_day FROM ticks GROUP BY 1 HAVING n_off + n_other_day > 0""")
def _(fx):
    return Q.off_session_ticks(fx("ticks"))


@query("q25_truncated_sessions", "ticks", "WITH f AS (SELECT symbol, trade_date, strftime(min(trade_time), '%H:%M:%S') AS first FROM ticks GROUP BY 1, 2) SELECT trade_date, count(*) AS n_symbols, count(*) FILTER (first > '09:25:59') AS n_late FROM f GROUP BY 1 HAVING count(*) FILTER (first > '09:25:59') >= 0.1 * count(*)")
def _(fx):
    return Q.truncated_sessions(fx("ticks"))


@query("q26_direction_mix", "ticks", "WITH p AS (SELECT trade_date, count(*) FILTER (direction NOT IN ('buy', 'sell')) AS n_unknown, count(*) FILTER (direction = 'buy') AS n_buy, count(*) FILTER (direction IN ('buy', 'sell')) AS n_sided FROM ticks GROUP BY 1) SELECT *, n_buy / nullif(n_sided, 0) AS buy_share FROM p WHERE n_unknown > 0 OR n_buy / nullif(n_sided, 0) > 0.9 OR n_buy / nullif(n_sided, 0) < 0.1")
def _(fx):
    return Q.direction_mix(fx("ticks"), ("buy", "sell"))


@query("q27_tick_reconciliation", "ticks tick_days", _RECON.format(a="price * volume", f="ticks") + " SELECT trade_date, round(volume_ratio, 9) AS volume_ratio, n FROM p WHERE n >= 20 AND (volume_ratio NOT BETWEEN 0.99999 AND 1.0 OR amount_ratio NOT BETWEEN 0.995 AND 1.005)")
def _(fx):
    out = Q.daily_reconciliation(fx("ticks"), fx("tick_days"), (0.99999, 1.0), (0.995, 1.005), amount=F.col("price") * F.col("volume"))
    return out.select("trade_date", F.round("volume_ratio", 9).alias("volume_ratio"), "n")


@query("q28_macro_staleness", "macro", "SELECT indicator_id, max(obs_date) AS last_obs, CAST(date_diff('day', max(obs_date), DATE '2001-11-30') AS INTEGER) AS lag_days FROM macro GROUP BY 1 HAVING date_diff('day', max(obs_date), DATE '2001-11-30') > 45")
def _(fx):
    return Q.macro_staleness(fx("macro"), "2001-11-30")


@query("q28_macro_revisions", "macro", "SELECT indicator_id, obs_date, value, CASE WHEN month(obs_date) = 3 THEN value * 1.1 ELSE value * 1.01 END AS new_value FROM macro WHERE month(obs_date) = 3")
def _(fx):
    new = fx("macro").withColumn("value", F.when(F.month("obs_date") == 3, F.col("value") * 1.1).otherwise(F.col("value") * 1.01))
    return Q.macro_revisions(fx("macro"), new)


@query("q29_breadth_integrity", "bars sessions status", """
WITH d AS (SELECT DISTINCT t.trade_date FROM bars t JOIN sessions s ON t.trade_date = s.trade_date JOIN bars p ON p.symbol = t.symbol AND p.trade_date = s.prev_date WHERE t.volume > 0 AND p.close > 0)
SELECT trade_date, 6 AS n, 6 AS n_distinct, 0 AS n_unknown FROM d WHERE dayofmonth(trade_date) = 5""")
def _(fx):
    b = D.market_breadth(fx("bars"), fx("sessions"), fx("status")).where("NOT (metric_id = 'flat_count' AND dayofmonth(trade_date) = 5)")
    return Q.breadth_integrity(b, D.BREADTH).select("trade_date", F.col("n").cast("int").alias("n"), F.col("n_distinct").cast("int").alias("n_distinct"), F.col("n_unknown").cast("int").alias("n_unknown"))


@query("q30_index_integrity", "bars factors sessions members", f"WITH {INDEX} SELECT trade_date, industry_code, level, 1 AS n_weightings, 1 AS n_rows FROM g WHERE level = 'L2' AND n_priced = 0")
def _(fx):
    i = D.industry_index(fx("members"), fx("bars"), fx("factors"), fx("sessions")).where("NOT (level = 'L2' AND n_priced = 0 AND weighting = 'amount')")
    return Q.index_integrity(i).select("trade_date", "industry_code", "level", F.col("n_weightings").cast("int").alias("n_weightings"), F.col("n_rows").cast("int").alias("n_rows"))


@query("q31_announce_sentinels", "facts", "SELECT source, count(*) AS n FROM facts WHERE announce_date IS NULL GROUP BY 1")
def _(fx):
    return Q.announce_sentinels(fx("facts"))


@query("q32_source_diff", "bars backup_bars", """
WITH b AS (SELECT p.symbol AS ps, k.symbol AS ks, coalesce(p.symbol, k.symbol) AS symbol, coalesce(p.trade_date, k.trade_date) AS trade_date, p.close AS pc, k.close AS kc, p.open AS po, k.open AS ko FROM bars p FULL JOIN (SELECT * FROM backup_bars) k ON p.symbol = k.symbol AND p.trade_date = k.trade_date)
SELECT symbol, trade_date, '*' AS field, CASE WHEN ps IS NULL THEN 'only_backup' ELSE 'only_primary' END AS state FROM b WHERE ps IS NULL OR ks IS NULL
UNION ALL SELECT symbol, trade_date, 'close', CASE WHEN (pc IS NULL) <> (kc IS NULL) THEN 'null_mismatch' ELSE 'drift' END FROM b WHERE ps IS NOT NULL AND ks IS NOT NULL AND ((pc IS NULL) <> (kc IS NULL) OR abs(pc - kc) / abs(kc) * 1e4 > 10)""")
def _(fx):
    return Q.source_diff(fx("bars"), fx("backup_bars"), KEY, ["close", "open"], 10.0)


@query("q32_diff_gate", "bars backup_bars", """
WITH n AS (SELECT count(*) AS n FROM bars), d AS (SELECT 'close' AS field, CASE WHEN k.close IS NULL THEN 'null_mismatch' ELSE 'drift' END AS state FROM bars p JOIN backup_bars k ON p.symbol = k.symbol AND p.trade_date = k.trade_date WHERE k.close IS NULL OR abs(p.close - k.close) / abs(k.close) * 1e4 > 10)
SELECT field, state, count(*) AS n, count(*) / (SELECT n FROM n) AS share FROM d GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM n) > 0.001""")
def _(fx):
    n = fx("bars").count()
    return Q.diff_gate(Q.source_diff(fx("bars"), fx("backup_bars"), KEY, ["close"], 10.0).where("field <> '*'"), n, 0.001)


@query("q33_publisher_drift", "bars backup_bars", "SELECT p.symbol, p.trade_date, round(abs(p.close - k.close) / abs(k.close) * 1e4, 6) AS worst_bps FROM bars p JOIN backup_bars k ON p.symbol = k.symbol AND p.trade_date = k.trade_date WHERE abs(p.close - k.close) / abs(k.close) * 1e4 > 10")
def _(fx):
    return Q.publisher_drift(fx("bars"), fx("backup_bars"), ["open", "close"], 10.0).withColumn("worst_bps", F.round("worst_bps", 6))


@query("q34_evidence_gaps", "bars intervals", "SELECT DISTINCT b.symbol, b.trade_date FROM bars b ANTI JOIN intervals i ON b.symbol = i.symbol AND b.trade_date BETWEEN i.start_date AND i.end_date")
def _(fx):
    receipts = fx("intervals").select("symbol", F.col("start_date").alias("window_start"), F.col("end_date").alias("window_end"))
    return Q.evidence_gaps(fx("bars").select(*KEY).distinct(), receipts)


@query("q34_unverified_pairs", "bars intervals status", """
WITH h AS (SELECT DISTINCT source, symbol, trade_date FROM status), w AS (SELECT DISTINCT symbol, x.source, CASE WHEN symbol LIKE '%5.SZ' THEN 'v0' ELSE 'v1' END AS version, start_date AS a, coalesce(end_date, DATE '2001-12-31') AS z FROM intervals CROSS JOIN (SELECT 'eastmoney' AS source UNION ALL SELECT 'baostock') x),
k AS (SELECT w.symbol, w.source, w.a, w.z FROM w WHERE version = 'v1' AND NOT (symbol LIKE '60%' AND source = 'baostock' AND month(a) = 2))
SELECT p.symbol, p.trade_date, count(DISTINCT k.source) AS n_sources FROM (SELECT DISTINCT symbol, trade_date FROM bars) p LEFT JOIN k ON p.symbol = k.symbol AND p.trade_date BETWEEN k.a AND k.z GROUP BY 1, 2 HAVING count(DISTINCT k.source) < 2""")
def _(fx):
    stored = fx("status").select("source", *KEY).distinct()
    old = F.when(F.col("symbol").like("%5.SZ"), "v0").otherwise("v1")
    named = fx("intervals").select("symbol", F.explode(F.array(F.lit("eastmoney"), F.lit("baostock"))).alias("source"), old.alias("version"), F.col("start_date").alias("window_start"), F.coalesce("end_date", F.lit("2001-12-31").cast("date")).alias("window_end"))
    inside = F.expr("r.source = s.source AND r.symbol = s.symbol AND s.trade_date BETWEEN r.window_start AND r.window_end")
    counted = named.distinct().alias("r").join(stored.alias("s"), inside, "left").groupBy("r.symbol", "r.source", "r.version", "r.window_start", "r.window_end").agg(F.count("s.trade_date").alias("n"))
    lost = F.col("symbol").startswith("60") & (F.col("source") == "baostock") & (F.month("window_start") == 2)
    receipts = counted.select("symbol", "source", "version", "window_start", "window_end", (F.col("n") + F.when(lost, 1).otherwise(0)).alias("n_rows"))
    return Q.unverified_pairs(fx("bars"), receipts, stored, ("eastmoney", "baostock"), "v1")


@query("q35_coverage_gaps", "bars sessions spans", """
WITH e AS (SELECT p.symbol, s.trade_date, b.symbol IS NOT NULL AS there FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar LEFT JOIN bars b ON b.symbol = p.symbol AND b.trade_date = s.trade_date), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM e),
m AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS island FROM n WHERE NOT there) SELECT symbol, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS n_missing FROM m GROUP BY symbol, island""")
def _(fx):
    return Q.coverage_gaps(fx("bars"), fx("sessions"))


@query("q36_stale_marks", "bars", "SELECT symbol AS dataset, max(trade_date) AS mark, CAST(date_diff('day', max(trade_date), DATE '2001-11-05') AS INTEGER) AS lag_days FROM bars GROUP BY 1 HAVING date_diff('day', max(trade_date), DATE '2001-11-05') > 6")
def _(fx):
    return Q.stale_marks(fx("bars").groupBy(F.col("symbol").alias("dataset")).agg(F.max("trade_date").alias("mark")), "2001-11-05", 6)


@query("q37_heatmap", "bars sessions spans", """
WITH e AS (SELECT p.symbol, s.trade_date, b.symbol IS NOT NULL AS there FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar LEFT JOIN bars b ON b.symbol = p.symbol AND b.trade_date = s.trade_date)
SELECT symbol, CAST(date_trunc('month', trade_date) AS DATE) AS month, count(*) FILTER (there) AS covered, count(*) FILTER (NOT there) AS missed FROM e GROUP BY 1, 2""")
def _(fx):
    return Q.heatmap(fx("bars"), fx("sessions"))


@query("q38_out_of_scope", "valuations instruments", "SELECT symbol, trade_date FROM valuations WHERE symbol NOT IN (SELECT symbol FROM instruments)")
def _(fx):
    return Q.out_of_scope(fx("valuations"), fx("instruments")).select(*KEY)


@query("q39_missing_keys", "bars sessions status spans", f"""
SELECT p.symbol, s.trade_date FROM spans p JOIN sessions s ON s.trade_date BETWEEN p.first_bar AND p.last_bar ANTI JOIN bars b ON b.symbol = p.symbol AND b.trade_date = s.trade_date
ANTI JOIN (SELECT * FROM status WHERE status IN ('suspended', 'delisted', 'not_listed')) x ON x.symbol = p.symbol AND x.trade_date = s.trade_date WHERE NOT {etf_sql('p.symbol')}""")
def _(fx):
    return Q.missing_keys(fx("bars"), fx("sessions"), fx("status"))


@query("q40_placeholder_days", "bars_raw", "SELECT trade_date, count(*) AS n, count(*) FILTER (volume = 0) AS n_placeholder FROM bars_raw GROUP BY 1 HAVING count(*) FILTER (volume = 0) > 0.25 * count(*)")
def _(fx):
    return Q.placeholder_days(fx("bars_raw"), 0.25)


@query("q41_audit", "bars_raw ticks macro", """
SELECT 'daily_bars' AS dataset, 'amount_completeness' AS check_name, 'warning' AS severity, source AS subject FROM bars_raw GROUP BY 4 HAVING count(*) >= 20 AND count(*) FILTER (amount IS NULL) > 0
UNION ALL SELECT 'daily_bars', 'pk_unique', 'error', symbol FROM (SELECT symbol, trade_date FROM bars_raw GROUP BY 1, 2 HAVING count(*) > 1) x
UNION ALL SELECT 'macro_indicators', 'macro_indicator_stale', 'warning', indicator_id FROM macro GROUP BY 4 HAVING date_diff('day', max(obs_date), DATE '2001-11-30') > 45""")
def _(fx):
    from ..operators.canonical import duplicate_keys

    report = Q.audit([
        ("daily_bars", "amount_completeness", "warning", "source", lambda: Q.amount_completeness(fx("bars_raw"))),
        ("daily_bars", "pk_unique", "error", "symbol", lambda: duplicate_keys(fx("bars_raw"), KEY)),
        ("macro_indicators", "macro_indicator_stale", "warning", "indicator_id", lambda: Q.macro_staleness(fx("macro"), "2001-11-30")),
    ])
    return report.select("dataset", "check_name", "severity", "subject")
