"""Queries of the derived-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjust
from ..plans import derive as D
from ..sources.lake import kept
from .core import query
from .operators import HFQ, KEY, etf_sql, universe_sql

POSITIVE, NEGATIVE = {"tion": 1.0, "ing": 1.2, "de": 0.9}, {"the": 1.1, "er": 0.8, "xyz": 1.3}
KEYWORDS = (("idiot", "penalty"), ("token", "investigation"), ("Th", "regulatory_letter"), ("queue", "warning_letter"))


def _lexicon_sql(column: str, lexicon: dict[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({column}, '{k}') THEN {w} ELSE 0.0 END" for k, w in lexicon.items()) + ")"


def _sentiment_sql(column: str) -> str:
    p, n = (f"CAST({_lexicon_sql(column, x)} AS DOUBLE)" for x in (POSITIVE, NEGATIVE))
    return f"CASE WHEN {p} + {n} = 0 THEN 0.0 ELSE ({p} - {n}) / ({p} + {n}) END"


@query("d1_market_breadth", "bars sessions status", """
WITH w AS (SELECT symbol, trade_date, bool_or(coalesce(risk_warning, false) OR status IN ('st', '*st')) AS warned FROM status GROUP BY 1, 2),
j AS (SELECT t.trade_date, (t.close - p.close) / p.close AS pct, CASE WHEN coalesce(w.warned, false) THEN 0.045 WHEN t.symbol LIKE '%.BJ' THEN 0.295 WHEN t.symbol LIKE '30%' OR t.symbol LIKE '688%' THEN 0.195 ELSE 0.095 END AS lim
  FROM bars t JOIN sessions s ON t.trade_date = s.trade_date JOIN bars p ON p.symbol = t.symbol AND p.trade_date = s.prev_date LEFT JOIN w ON w.symbol = t.symbol AND w.trade_date = t.trade_date WHERE t.volume > 0 AND p.close > 0),
g AS (SELECT trade_date, CAST(count(*) FILTER (pct > 0) AS DOUBLE) AS advance_count, CAST(count(*) FILTER (pct < 0) AS DOUBLE) AS decline_count, CAST(count(*) FILTER (pct = 0) AS DOUBLE) AS flat_count,
  CAST(count(*) FILTER (pct >= lim) AS DOUBLE) AS limit_up_count, CAST(count(*) FILTER (pct <= -lim) AS DOUBLE) AS limit_down_count, count(*) FILTER (pct > 0) / count(*) AS advance_ratio, CAST(count(*) AS DOUBLE) AS total_count FROM j GROUP BY 1)
SELECT trade_date, metric_id, value FROM g UNPIVOT (value FOR metric_id IN (advance_count, decline_count, flat_count, limit_up_count, limit_down_count, advance_ratio, total_count))""")
def _(fx):
    return D.market_breadth(fx("bars"), fx("sessions"), fx("status"))


INDEX = f"""{HFQ}, lagged AS (SELECT *, close * factor AS ac, lag(close * factor) OVER w AS pp, lag(trade_date) OVER w AS pd FROM adj WHERE adj_is_exact AND (volume > 0 OR volume IS NULL) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
rets AS (SELECT l.symbol, l.trade_date, l.ac / l.pp - 1 AS ret, CASE WHEN l.amount >= 1 THEN l.amount END AS amount FROM lagged l JOIN sessions s ON l.trade_date = s.trade_date AND l.pd = s.prev_date WHERE l.pp <> 0),
mem AS (SELECT * FROM members WHERE source = 'sw'), days AS (SELECT DISTINCT trade_date FROM rets),
snap AS (SELECT d.trade_date, max(m.as_of_date) AS as_of_date FROM days d JOIN (SELECT DISTINCT as_of_date FROM mem) m ON m.as_of_date <= d.trade_date GROUP BY 1),
x AS (SELECT s.trade_date, m.symbol, l.level, left(m.industry_code, l.n) AS industry_code, r.ret, r.amount FROM mem m JOIN snap s ON m.as_of_date = s.as_of_date LEFT JOIN rets r ON r.symbol = m.symbol AND r.trade_date = s.trade_date
  CROSS JOIN (VALUES ('L1', 2), ('L2', 4), ('L3', 6)) l(level, n)),
g AS (SELECT trade_date, industry_code, level, count(DISTINCT symbol) AS n_members, count(DISTINCT CASE WHEN ret IS NOT NULL THEN symbol END) AS n_priced, avg(ret) AS e, sum(ret * amount) / nullif(sum(CASE WHEN ret IS NOT NULL THEN amount END), 0) AS a,
  sum(CASE WHEN ret IS NOT NULL THEN amount END) AS amount FROM x GROUP BY 1, 2, 3)"""


@query("d2_industry_index", "bars factors sessions members", f"""WITH {INDEX}
SELECT trade_date, industry_code, level, 'equal' AS weighting, round(e, 8) AS ret, n_members, n_priced, n_members - n_priced AS n_excluded, round(amount, 2) AS amount FROM g
UNION ALL SELECT trade_date, industry_code, level, 'amount', round(a, 8), n_members, n_priced, n_members - n_priced, round(amount, 2) FROM g""")
def _(fx):
    out = D.industry_index(fx("members"), fx("bars"), fx("factors"), fx("sessions"))
    return out.select("trade_date", "industry_code", "level", "weighting", F.round("ret", 8).alias("ret"), "n_members", "n_priced", "n_excluded", F.round("amount", 2).alias("amount"))


@query("d3_adj_factors", "bars factor_events", "SELECT b.symbol, b.trade_date, 'hfq' AS adjust_type, coalesce(e.factor, 1.0) AS factor FROM bars b ASOF LEFT JOIN factor_events e ON b.symbol = e.symbol AND b.trade_date >= e.ex_date")
def _(fx):
    return D.adj_factors(fx("factor_events"), fx("bars"))


@query("d4_symbols_to_refresh", "bars_raw factors actions instruments", """
WITH r AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS z, count(DISTINCT trade_date) AS n FROM bars_raw WHERE volume > 0 OR volume IS NULL GROUP BY 1), k AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS z, count(DISTINCT trade_date) AS n FROM factors WHERE trade_date >= DATE '1995-06-30' GROUP BY 1)
SELECT r.symbol FROM r LEFT JOIN k ON r.symbol = k.symbol JOIN instruments i ON i.symbol = r.symbol WHERE i.asset_type IN ('stock', 'etf') AND (k.a IS NULL OR k.a > r.a OR (k.z >= r.z AND k.n < r.n))
UNION SELECT symbol FROM actions WHERE ex_date = DATE '1995-01-05' UNION SELECT symbol FROM instruments WHERE list_date = DATE '1995-01-05'""")
def _(fx):
    return D.symbols_to_refresh(fx("bars_raw"), fx("factors").where("trade_date >= DATE '1995-06-30'"), fx("actions"), fx("instruments"), "1995-01-05")


@query("d4_bars_to_derive", "bars factors actions", """
SELECT symbol, trade_date FROM bars WHERE trade_date > DATE '2001-03-30' UNION SELECT b.symbol, b.trade_date FROM bars b ANTI JOIN factors f ON b.symbol = f.symbol AND b.trade_date = f.trade_date WHERE b.trade_date BETWEEN DATE '2001-03-28' AND DATE '2001-03-30'
UNION SELECT symbol, trade_date FROM bars WHERE symbol IN (SELECT symbol FROM actions WHERE ex_date = DATE '1998-03-10')""")
def _(fx):
    acted = fx("actions").where("ex_date = DATE '1998-03-10'").select("symbol").distinct()
    return D.bars_to_derive(fx("bars"), fx("factors"), acted, "2001-03-30")


@query("d5_suspension_history", "bars sessions instruments spans", f"""
WITH life AS (SELECT p.symbol, greatest(i.list_date, p.first_bar) AS lo, least(i.delist_date, p.last_bar) AS hi FROM spans p JOIN instruments i ON p.symbol = i.symbol WHERE NOT {etf_sql('p.symbol')})
SELECT l.symbol, s.trade_date, false AS is_trading, 'suspended' AS status, CAST(NULL AS BOOLEAN) AS risk_warning FROM life l JOIN sessions s ON s.trade_date BETWEEN l.lo AND l.hi ANTI JOIN (SELECT * FROM bars WHERE volume > 0) b ON b.symbol = l.symbol AND b.trade_date = s.trade_date""")
def _(fx):
    return D.suspension_history(fx("bars"), fx("sessions"), fx("instruments"))


@query("d6_regulatory_events", "announcements", f"""
SELECT 'reg-' || announcement_id AS event_id, symbol, announce_date AS event_date, CASE {' '.join(f"WHEN contains(title, '{k}') THEN '{t}'" for k, t in KEYWORDS)} END AS event_type, title
FROM announcements WHERE title IS NOT NULL AND ({' OR '.join(f"contains(title, '{k}')" for k, _ in KEYWORDS)})""")
def _(fx):
    return D.regulatory_events(fx("announcements"), KEYWORDS)


@query("d7_sentiment_scores", "announcements headlines", f"""
WITH a AS (SELECT symbol, announce_date AS trade_date, 'announcement' AS score_channel, {_sentiment_sql('title')} AS s FROM announcements),
h AS (SELECT upper(trim(u.x)) AS symbol, publish_date AS trade_date, 'news' AS score_channel, {_sentiment_sql('title')} AS s FROM headlines, unnest(regexp_split_to_array(related_symbols, '[;,]')) u(x))
SELECT symbol, trade_date, score_channel, round(avg(s), 8) AS sentiment_score, count(*) AS headline_count FROM (SELECT * FROM a UNION ALL SELECT * FROM h WHERE regexp_full_match(symbol, '[0-9]{{6}}\\.(SH|SZ)')) x GROUP BY 1, 2, 3""")
def _(fx):
    return D.sentiment_scores(fx("announcements"), fx("headlines"), POSITIVE, NEGATIVE).withColumn("sentiment_score", F.round("sentiment_score", 8))


@query("d8_delisting_events", "bars", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars), l AS (SELECT symbol, trade_date, close, date_diff('day', lag(trade_date) OVER w, trade_date) AS gap, close / lag(close) OVER w - 1 AS r FROM t WHERE rn <= 60 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
e AS (SELECT symbol, max(gap) AS gap, min(r) AS worst, max_by(close, trade_date) AS final, min_by(close, trade_date) AS beg FROM l GROUP BY 1), b AS (SELECT symbol, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, count(*) AS bars FROM bars GROUP BY 1)
SELECT b.symbol, first_trade_date, last_trade_date, CASE WHEN bars < 30 THEN 'insufficient' WHEN gap > 10 AND worst < -0.25 THEN 'consolidation' WHEN final / beg - 1 < -0.40 AND final < 2.0 THEN 'abrupt_decline' ELSE 'abrupt_stable' END AS ending_pattern,
  CASE WHEN bars >= 30 THEN final END AS final_close, CASE WHEN bars >= 30 THEN gap END AS halt_gap_days, CASE WHEN bars >= 30 THEN worst END AS worst_final_return, CASE WHEN bars >= 30 THEN final / beg - 1 END AS final_window_return, bars
FROM b JOIN e ON b.symbol = e.symbol""")
def _(fx):
    return D.delisting_events(fx("bars"))


@query("d9_industry_members_history", "intervals month_ends", """
WITH x AS (SELECT i.symbol, i.industry_code, m.as_of_date, row_number() OVER (PARTITION BY i.symbol, m.as_of_date ORDER BY i.start_date DESC) AS rn FROM intervals i JOIN month_ends m ON i.start_date <= m.as_of_date)
SELECT symbol, industry_code, as_of_date FROM x WHERE rn = 1 AND as_of_date IN (SELECT as_of_date FROM x WHERE rn = 1 GROUP BY as_of_date HAVING count(DISTINCT symbol) >= 20)""")
def _(fx):
    return D.industry_members_history(fx("intervals"), fx("month_ends"), 20)


@query("d10_index_constituents_history", "intervals month_ends", "SELECT DISTINCT i.symbol, i.industry_code, m.as_of_date FROM intervals i JOIN month_ends m ON i.start_date <= m.as_of_date AND (i.end_date IS NULL OR m.as_of_date < i.end_date)")
def _(fx):
    return D.index_constituents_history(fx("intervals"), fx("month_ends"))


@query("d11_merge_instruments", "instruments spans", """
WITH inc AS (SELECT symbol, 'renamed ' || symbol AS name, 'XX' AS exchange, 'stock' AS asset_type, CAST(NULL AS DATE) AS list_date, CAST(NULL AS DATE) AS delist_date FROM spans WHERE n_bars > 530),
f AS (SELECT symbol, last_bar FROM spans WHERE n_bars > 540)
SELECT coalesce(b.symbol, a.symbol) AS symbol, CASE WHEN b.symbol IS NULL THEN a.name ELSE b.name END AS name, CASE WHEN b.symbol IS NULL THEN a.exchange ELSE b.exchange END AS exchange, coalesce(b.list_date, a.list_date) AS list_date,
  coalesce(f.last_bar, b.delist_date, a.delist_date) AS delist_date FROM instruments a FULL JOIN inc b ON a.symbol = b.symbol LEFT JOIN f ON f.symbol = coalesce(b.symbol, a.symbol)""")
def _(fx):
    p = fx("spans")
    null = F.lit(None).cast("date")
    inc = p.where("n_bars > 530").select("symbol", F.concat(F.lit("renamed "), "symbol").alias("name"), F.lit("XX").alias("exchange"), F.lit("stock").alias("asset_type"), null.alias("list_date"), null.alias("delist_date"))
    formal = p.where("n_bars > 540").select("symbol", F.col("last_bar").alias("delist_date"))
    return D.merge_instruments(fx("instruments").drop("prev_symbol"), inc, formal).select("symbol", "name", "exchange", "list_date", "delist_date")


@query("d13_life_status", "instruments sessions", """
SELECT i.symbol, s.trade_date, 'not_listed' AS status, false AS is_trading FROM instruments i JOIN sessions s ON s.trade_date < i.list_date UNION ALL SELECT i.symbol, s.trade_date, 'delisted', false FROM instruments i JOIN sessions s ON s.trade_date > i.delist_date""")
def _(fx):
    return D.life_status(fx("instruments"), fx("sessions"))


@query("d14_calibrate_st", "status instruments", "SELECT s.symbol, s.trade_date, s.source, CASE WHEN regexp_matches(i.name, '^\\*?ST') THEN true ELSE s.risk_warning END AS risk_warning FROM status s LEFT JOIN instruments i ON s.symbol = i.symbol")
def _(fx):
    return D.calibrate_st(fx("status"), fx("instruments")).select(*KEY, "source", "risk_warning")


@query("d15_trading_calendar", "bars actions", """
WITH h AS (SELECT DISTINCT ex_date FROM actions WHERE month(ex_date) = 10 AND day(ex_date) <= 7), d AS (SELECT unnest(generate_series((SELECT min(trade_date) FROM bars), (SELECT max(trade_date) FROM bars), INTERVAL 1 DAY))::DATE AS trade_date)
SELECT trade_date, isodow(trade_date) <= 5 AND trade_date NOT IN (SELECT ex_date FROM h) AS is_trading FROM d""")
def _(fx):
    holidays = fx("actions").where("month(ex_date) = 10 AND day(ex_date) <= 7").select(F.col("ex_date").alias("trade_date")).distinct()
    return D.trading_calendar(fx("bars"), holidays)


NORM = "replace(replace(regexp_replace({0}, '[ⅠⅡⅢIVⅣ\\s]', '', 'g'), '概念', ''), '板块', '')"


@query("d16_sector_code_map", "boards", f"""
WITH b AS (SELECT 'BK' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS sector_code, CAST(p_partkey AS VARCHAR) AS board_code, p_brand || p_type AS name FROM part)
SELECT s.sector_code, s.sector_name, b.board_code, CASE WHEN b.board_code IS NULL THEN 'unmatched' WHEN {NORM.format('s.sector_name')} = {NORM.format('b.name')} THEN 'code_and_name' ELSE 'code_only' END AS match_type FROM boards s LEFT JOIN b ON s.sector_code = b.sector_code""")
def _(fx):
    b = fx("part").select(F.col("p_partkey").cast("string").alias("board_code"), F.concat("p_brand", "p_type").alias("board_name"))
    return D.sector_code_map(fx("boards"), b)


@query("d17_sector_routing", "boards board_indices", f"""
WITH l AS (SELECT *, {NORM.format('sector_name')} AS k FROM boards), r AS (SELECT tdx_code, {NORM.format('trim(name)')} AS k FROM board_indices),
e AS (SELECT k, count(DISTINCT tdx_code) AS n, min(tdx_code) AS c FROM r GROUP BY k), f AS (SELECT l.sector_code, count(DISTINCT tdx_code) AS n, min(tdx_code) AS c FROM l JOIN r ON length(l.k) >= 2 AND (contains(r.k, l.k) OR contains(l.k, r.k)) GROUP BY 1),
x AS (SELECT l.*, e.c AS ec, f.c AS fc, CASE WHEN e.n = 1 AND board_type = 'industry' THEN 'industry_exact' WHEN e.n = 1 THEN 'concept_exact' WHEN e.n > 1 THEN 'exact_ambiguous' WHEN f.n = 1 THEN 'fuzzy_unique' WHEN f.n > 1 THEN 'fuzzy_ambiguous' ELSE 'no_tdx_match' END AS reason
  FROM l LEFT JOIN e ON l.k = e.k LEFT JOIN f ON l.sector_code = f.sector_code)
SELECT sector_code, sector_name, board_type, CASE WHEN reason IN ('industry_exact', 'concept_exact', 'fuzzy_unique') THEN 'tdx' ELSE 'em' END AS ohlc_source, CASE WHEN reason IN ('industry_exact', 'concept_exact') THEN ec WHEN reason = 'fuzzy_unique' THEN fc END AS tdx_code,
  CASE reason WHEN 'industry_exact' THEN 'T1' WHEN 'concept_exact' THEN 'T2' WHEN 'fuzzy_unique' THEN 'T3' ELSE 'T4' END AS routing_tier, reason FROM x""")
def _(fx):
    return D.sector_routing(fx("boards"), fx("board_indices"))


@query("d18_purge_orphans", "valuations bars", "SELECT v.symbol, v.trade_date, v.pe_ttm FROM valuations v WHERE symbol IN (SELECT symbol FROM bars WHERE volume > 0)")
def _(fx):
    return D.purge_orphans(fx("valuations"), fx("bars")).select(*KEY, "pe_ttm")


@query("d19_supplement_amount", "bars bars_raw", """
SELECT r.symbol, r.trade_date, r.source, coalesce(r.amount, b.amount) AS amount FROM bars_raw r LEFT JOIN bars b ON r.symbol = b.symbol AND r.trade_date = b.trade_date AND r.open = b.open AND r.high = b.high AND r.low = b.low AND r.close = b.close AND r.volume = b.volume""")
def _(fx):
    return D.supplement_amount(fx("bars_raw"), fx("bars")).select(*KEY, "source", "amount")


@query("d20_survivorship_gap", "bars instruments", """
WITH h AS (SELECT symbol, year(trade_date) AS year, max_by(close, trade_date) / min_by(close, trade_date) - 1 AS r FROM bars GROUP BY 1, 2), x AS (SELECT h.*, i.delist_date IS NULL AS alive FROM h LEFT JOIN instruments i ON h.symbol = i.symbol)
SELECT CAST(year AS INTEGER) AS year, count(*) AS n_all, count(*) FILTER (alive) AS n_survivors, round(avg(r), 8) AS complete, round(avg(r) FILTER (alive), 8) AS survivors, round((avg(r) FILTER (alive) - avg(r)) * 100, 6) AS gap_pp FROM x GROUP BY 1""")
def _(fx):
    out = D.survivorship_gap(fx("bars"), fx("instruments"))
    return out.select("year", "n_all", "n_survivors", F.round("complete", 8).alias("complete"), F.round("survivors", 8).alias("survivors"), F.round("gap_pp", 6).alias("gap_pp"))


@query("d21_symbol_summary", "bars_raw status members valuations", """
WITH b AS (SELECT symbol, max_by(close, (trade_date, fetched_at, source)) AS close, max(trade_date) AS bar_date FROM bars_raw GROUP BY 1), s AS (SELECT symbol, max_by(status, (trade_date, fetched_at, source)) AS status FROM status GROUP BY 1),
v AS (SELECT symbol, max_by(pe_ttm, trade_date) AS pe_ttm FROM valuations GROUP BY 1), m AS (SELECT symbol, industry_code FROM members WHERE as_of_date = (SELECT max(as_of_date) FROM members))
SELECT b.symbol, b.bar_date, b.close, s.status, v.pe_ttm, m.industry_code FROM b LEFT JOIN s ON b.symbol = s.symbol LEFT JOIN v ON b.symbol = v.symbol LEFT JOIN m ON b.symbol = m.symbol""")
def _(fx):
    from ..plans.reports import symbol_summary

    return symbol_summary(fx("bars_raw"), fx("status"), fx("valuations"), fx("members"))


@query("d22_daily_kline_page", "bars factors", f"WITH {HFQ}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM adj WHERE trade_date > DATE '1997-06-30') SELECT symbol, trade_date, close * factor AS adj_close, adj_is_exact FROM p WHERE rn <= 101")
def _(fx):
    from ..plans.reports import kline_pages

    return kline_pages(adjust.hfq(fx("bars"), fx("factors")), "trade_date", "1997-06-30", 100).select(*KEY, "adj_close", "adj_is_exact")


@query("d24_minute_kline", "minute_bars factors", "SELECT m.symbol, m.bar_time, m.close * coalesce(f.factor, 1.0) AS adj_close FROM minute_bars m LEFT JOIN factors f ON m.symbol = f.symbol AND m.trade_date = f.trade_date")
def _(fx):
    return adjust.hfq(fx("minute_bars"), fx("factors")).select("symbol", "bar_time", "adj_close")


@query("d26_volume_to_shares", "bars_raw", "SELECT symbol, trade_date, source, CASE WHEN data_version = 'v1' THEN volume * 100 ELSE volume END AS volume, 'v2' AS data_version FROM bars_raw")
def _(fx):
    return D.volume_to_shares(fx("bars_raw")).select(*KEY, "source", "volume", "data_version")


@query("d27_migrate_status", "status", "SELECT symbol, trade_date, source, CASE WHEN status IN ('st', '*st') THEN 'normal' ELSE status END AS status, coalesce(risk_warning, false) OR status IN ('st', '*st') AS risk_warning FROM status")
def _(fx):
    return D.migrate_status(fx("status")).select(*KEY, "source", "status", "risk_warning")


CATALOG = """c AS (SELECT symbol, CAST(last_bar - CAST(n_bars % 3 AS INTEGER) AS DATE) AS last_traded FROM spans WHERE n_bars % 4 <> 0 UNION ALL SELECT symbol, max(trade_date) FROM valuations WHERE symbol LIKE '99%' GROUP BY 1)"""


def _catalog(fx):
    last = fx("spans").where("n_bars % 4 <> 0").select("symbol", F.date_sub("last_bar", (F.col("n_bars") % 3).cast("int")).alias("last_traded"))
    return last.unionByName(fx("valuations").where("symbol LIKE '99%'").groupBy("symbol").agg(F.max("trade_date").alias("last_traded")))


IN_WINDOW = "BETWEEN DATE '1996-01-01' AND DATE '2001-09-28'"
OVERLAP = f"(last_traded {IN_WINDOW} OR (last_traded > DATE '2001-09-28' AND last_bar IS NOT NULL))"
NO_PRINT = "coalesce(delist_date = last_traded + 1 AND date_diff('day', last_bar, last_traded) BETWEEN 1 AND 3, false)"


@query("d29_delisted_coverage", "instruments spans valuations bars", f"""
WITH {CATALOG}, s AS (SELECT symbol, max(trade_date) AS last_bar FROM bars WHERE volume > 0 AND trade_date {IN_WINDOW} GROUP BY 1),
r AS (SELECT coalesce(c.symbol, i.symbol) AS symbol, c.last_traded, i.delist_date, s.last_bar, i.symbol IS NOT NULL AS listed FROM c FULL JOIN instruments i ON c.symbol = i.symbol LEFT JOIN s ON s.symbol = coalesce(c.symbol, i.symbol)),
f AS (SELECT *, 'missing_bars' AS finding FROM r WHERE last_traded {IN_WINDOW} AND last_bar IS NULL UNION ALL SELECT *, 'unknown_overlap' FROM r WHERE last_traded > DATE '2001-09-28' AND last_bar IS NULL
  UNION ALL SELECT *, CASE WHEN {NO_PRINT} THEN 'terminal_nonprinting' ELSE 'terminal_mismatch' END FROM r WHERE last_traded {IN_WINDOW} AND last_bar <> last_traded
  UNION ALL SELECT *, 'missing_instrument' FROM r WHERE NOT listed AND {OVERLAP} UNION ALL SELECT *, 'invalid_delist_date' FROM r WHERE listed AND {OVERLAP} AND (delist_date IS NULL OR delist_date < last_traded)
  UNION ALL SELECT *, 'formal_no_overlap' FROM r WHERE last_traded < DATE '1996-01-01' AND delist_date {IN_WINDOW} UNION ALL SELECT *, 'formal_unresolved' FROM r WHERE last_traded IS NULL AND delist_date {IN_WINDOW} AND last_bar IS NULL
  UNION ALL SELECT *, 'invalid_delist_date' FROM r WHERE last_traded IS NULL AND delist_date {IN_WINDOW} AND delist_date < last_bar)
SELECT symbol, last_traded, delist_date, last_bar, finding FROM f UNION ALL SELECT symbol, last_traded, delist_date, last_bar, 'complete' FROM r WHERE (last_traded >= DATE '1996-01-01' OR delist_date {IN_WINDOW}) AND symbol NOT IN (SELECT symbol FROM f)""")
def _(fx):
    return D.delisted_coverage(_catalog(fx), fx("instruments"), fx("bars"), "1996-01-01", "2001-09-28")


@query("d30_ownership", "valuations instruments bars status sessions", f"""
WITH w AS (SELECT trade_date FROM sessions WHERE trade_date BETWEEN DATE '1998-01-05' AND DATE '1998-01-06'), d AS (SELECT symbol, trade_date, bool_or(is_trading) AS t FROM status GROUP BY 1, 2),
st AS (SELECT d.symbol, count(w.trade_date) AS n, count(*) FILTER (w.trade_date IS NOT NULL AND NOT t) AS closed, coalesce(bool_or(t AND w.trade_date IS NOT NULL), false) AS pos FROM d LEFT JOIN w ON d.trade_date = w.trade_date GROUP BY 1),
x AS (SELECT v.symbol, i.symbol IS NOT NULL AS known, i.*, st.n, st.closed, coalesce(st.pos, false) AS pos, (SELECT count(*) FROM w) AS ns, v.symbol IN (SELECT symbol FROM bars WHERE volume > 0) AS ever, v.symbol LIKE '%5.SZ' AS neg
  FROM (SELECT DISTINCT symbol FROM valuations) v LEFT JOIN (SELECT symbol, list_date, delist_date, asset_type FROM instruments) i ON v.symbol = i.symbol LEFT JOIN st ON st.symbol = v.symbol)
SELECT symbol, CASE WHEN NOT known THEN 'unknown' WHEN list_date > DATE '1998-01-06' THEN 'not_listed' WHEN delist_date < DATE '1998-01-05' THEN 'delisted_before_window' WHEN delist_date <= DATE '1998-01-06' AND NOT {etf_sql('symbol')} THEN 'delegated_delisted'
  WHEN n IS NOT NULL AND ns > 0 AND closed = ns THEN 'non_trading' WHEN n IS NOT NULL AND ns > 0 AND NOT pos THEN 'unknown' WHEN neg AND NOT pos THEN 'negative_evidence' WHEN list_date IS NULL AND NOT ever THEN 'placeholder' ELSE 'generic' END AS ownership FROM x""")
def _(fx):
    symbols = fx("valuations").select("symbol").distinct()
    evidence = symbols.where("symbol LIKE '%5.SZ'").select("symbol", F.lit("1998-01-01").cast("date").alias("start_date"), F.lit("1998-12-31").cast("date").alias("end_date"))
    return D.ownership(symbols, fx("instruments"), fx("bars"), fx("status"), fx("sessions"), "1998-01-05", "1998-01-06", evidence)


@query("d33_statement_items", "facts", """
WITH w AS (SELECT symbol, report_period, min(announce_date) AS notice_date, round(sum(item_value), 2) AS revenue, round(max(item_value), 2) AS profit FROM facts GROUP BY 1, 2), a AS (SELECT symbol, report_period, min(announce_date) AS d FROM facts WHERE source = 'eastmoney' GROUP BY 1, 2)
SELECT w.symbol, w.report_period, item_code, item_value, coalesce(a.d, w.notice_date) AS announce_date FROM (SELECT * FROM w UNPIVOT (item_value FOR item_code IN (revenue, profit))) w LEFT JOIN a ON w.symbol = a.symbol AND w.report_period = a.report_period""")
def _(fx):
    wide = fx("facts").groupBy("symbol", "report_period").agg(F.min("announce_date").alias("notice_date"), F.round(F.sum("item_value"), 2).alias("revenue"), F.round(F.max("item_value"), 2).alias("profit"))
    dates = fx("facts").where("source = 'eastmoney' AND announce_date IS NOT NULL")
    return D.statement_items(wide, ["revenue", "profit"], dates).select("symbol", "report_period", "item_code", "item_value", "announce_date")


@query("d34_action_rows", "actions", """
SELECT symbol, ex_date, 'cash_dividend' AS action_type, cash_dividend * 10 / 10 AS per_share FROM actions WHERE cash_dividend > 0
UNION ALL SELECT symbol, ex_date, CASE WHEN month(ex_date) % 4 = 0 THEN 'transfer' ELSE 'bonus' END, bonus_ratio * 10 / 10 FROM actions WHERE bonus_ratio > 0""")
def _(fx):
    even = F.month("ex_date") % 2 == 0
    ten = F.col("bonus_ratio") * 10
    text = F.when(F.month("ex_date") % 4 == 0, "10转增").otherwise("10送")
    plans = fx("actions").select(
        "symbol", "ex_date", (F.col("cash_dividend") * 10).alias("cash_per_10"), F.when(~even, ten).alias("bonus_per_10"), F.lit(None).cast("double").alias("transfer_per_10"), F.when(even, ten).alias("combined_per_10"), text.alias("plan_text")
    )
    return D.action_rows(plans)


@query("d34_plan_actions", "actions", """
SELECT symbol, ex_date, 'cash_dividend' AS action_type, round(cash_dividend * 10) / 10 AS per_share FROM actions WHERE round(cash_dividend * 10) > 0 UNION ALL SELECT symbol, ex_date, 'bonus', round(bonus_ratio * 10) / 10 FROM actions WHERE round(bonus_ratio * 10) > 0
UNION ALL SELECT symbol, ex_date, 'allotment', 3 / 10 FROM actions WHERE day(ex_date) = 7""")
def _(fx):
    whole = lambda c: F.round(F.col(c) * 10).cast("int").cast("string")
    text = F.concat(F.lit("10 派 "), whole("cash_dividend"), F.lit("元送"), whole("bonus_ratio"), F.lit("股"), F.when(F.dayofmonth("ex_date") == 7, "配3股，配股价5.5元").otherwise(""))
    return D.plan_actions(fx("actions").select("symbol", "ex_date", text.alias("plan"), F.lit("实施方案").alias("progress"))).drop("allotment_price")


@query("d35_market_value", "bars factor_events", """
SELECT b.symbol, b.trade_date, b.close * e.factor * 1000 AS total_mv, CASE WHEN b.volume > 12 AND b.amount > 0 THEN round(b.amount / (b.volume / 10.0 / 100), 4) END AS float_mv
FROM bars b ASOF LEFT JOIN factor_events e ON b.symbol = e.symbol AND b.trade_date >= e.ex_date""")
def _(fx):
    shares = fx("factor_events").select("symbol", F.col("ex_date").alias("change_date"), F.col("factor").alias("total_shares"))
    bars = fx("bars").withColumn("turnover_pct", F.when(F.col("volume") > 12, F.col("volume") / 10.0).otherwise(0.0))
    return D.market_value(bars, shares).select(*KEY, (F.col("total_mv") * 1000).alias("total_mv"), F.round("float_mv", 4).alias("float_mv"))


@query("d36_macro_series", "", "SELECT 'm' || (o_custkey % 4) AS indicator_id, last_day(o_orderdate) AS obs_date, o_totalprice AS value, o_orderkey FROM orders")
def _(fx):
    raw = fx("orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("indicator_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("string").alias("value"), "o_orderkey")
    keyed = raw.withColumn("indicator_id", F.concat_ws("#", "indicator_id", F.col("o_orderkey").cast("string")))
    out = D.macro_series(keyed)
    return out.select(F.substring_index("indicator_id", "#", 1).alias("indicator_id"), "obs_date", "value", F.substring_index("indicator_id", "#", -1).cast("long").alias("o_orderkey"))


@query("d37_backfill_plan", "instruments spans", "SELECT i.symbol, greatest(i.list_date, DATE '1995-01-03') AS fetch_start FROM instruments i LEFT JOIN spans p ON i.symbol = p.symbol WHERE i.asset_type = 'stock' AND (p.first_bar IS NULL OR p.first_bar > greatest(i.list_date, DATE '1995-01-03'))")
def _(fx):
    return D.backfill_plan(fx("instruments"), fx("spans"), "1995-01-03")


@query("d38_recovery_targets", "valuations bars", "SELECT DISTINCT symbol FROM valuations WHERE symbol NOT IN (SELECT symbol FROM bars)")
def _(fx):
    return fx("valuations").select("symbol").distinct().join(fx("bars").select("symbol"), "symbol", "left_anti")


@query("d39_complete_dates", "bars", "SELECT trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) >= 20")
def _(fx):
    return D.complete_dates(fx("bars"), "trade_date", "symbol", 20)


@query("d41_capture_scope", "members", "SELECT DISTINCT symbol FROM members WHERE as_of_date = (SELECT max(as_of_date) FROM members)")
def _(fx):
    return D.capture_scope(fx("members"))


@query("d43_retired_names", "bars_raw instruments spans valuations", f"""
WITH {CATALOG}, l AS (SELECT symbol, min(trade_date) AS first_bar, max(trade_date) AS last_bar FROM bars_raw WHERE volume > 0 OR volume IS NULL GROUP BY 1),
n AS (SELECT b.symbol, count(DISTINCT b.trade_date) AS n FROM bars_raw b JOIN l ON b.symbol = l.symbol WHERE b.trade_date > l.last_bar GROUP BY 1),
q AS (SELECT l.symbol, CAST(NULL AS DATE) AS last_traded FROM l WHERE date_diff('day', l.last_bar, (SELECT max(trade_date) FROM bars_raw)) > 3 AND symbol NOT IN (SELECT symbol FROM instruments WHERE delist_date IS NOT NULL) AND symbol NOT IN (SELECT symbol FROM n WHERE n.n >= 20)),
t AS (SELECT symbol, max(last_traded) AS last_traded FROM (SELECT * FROM c UNION ALL SELECT * FROM q) u WHERE NOT {etf_sql('symbol')} GROUP BY 1)
SELECT t.symbol, l.first_bar AS list_date, greatest(t.last_traded, l.last_bar) AS delist_date FROM t LEFT JOIN l ON t.symbol = l.symbol""")
def _(fx):
    return D.retired_names(fx("bars_raw"), fx("instruments"), _catalog(fx), quiet_days=3)


ALIVE = "(i.list_date IS NULL OR i.list_date <= s.trade_date) AND (i.delist_date IS NULL OR i.delist_date > s.trade_date)"
HISTORY = "h AS (SELECT symbol, trade_date, bool_or(is_trading) AS is_trading, max(status) AS status, bool_or(risk_warning) AS risk_warning FROM status GROUP BY 1, 2)"


@query("d45_assemble_status", "status instruments sessions", f"""
WITH {HISTORY}, a AS (SELECT i.symbol, s.trade_date FROM instruments i JOIN sessions s ON {ALIVE}),
k AS (SELECT s.trade_date, max(x.trade_date) AS stored FROM sessions s JOIN (SELECT DISTINCT trade_date FROM h) x ON x.trade_date < s.trade_date AND date_diff('day', x.trade_date, s.trade_date) <= 5 WHERE day(s.trade_date) % 5 = 0 GROUP BY 1)
SELECT symbol, trade_date, true AS is_trading, 'normal' AS status, false AS risk_warning, 'eastmoney' AS source FROM a WHERE day(trade_date) % 5 <> 0
UNION ALL SELECT a.symbol, a.trade_date, coalesce(h.is_trading, false), CASE WHEN h.symbol IS NULL THEN 'suspended' ELSE h.status END, h.risk_warning, 'eastmoney_cached' FROM a JOIN k ON a.trade_date = k.trade_date LEFT JOIN h ON h.symbol = a.symbol AND h.trade_date = k.stored
UNION ALL SELECT i.symbol, s.trade_date, false, 'delisted', NULL, 'derived_delisted' FROM instruments i JOIN sessions s ON i.delist_date <= s.trade_date
UNION ALL SELECT i.symbol, s.trade_date, false, 'not_listed', NULL, 'derived_not_listed' FROM instruments i JOIN sessions s ON i.list_date > s.trade_date AND (i.delist_date IS NULL OR i.delist_date > s.trade_date)""")
def _(fx):
    live, history, days, listed = _status_inputs(fx)
    return D.assemble_status(live, kept(history, "d45-history"), listed, days)


@query("d45_status_presence", "instruments sessions", f"""
SELECT s.trade_date, count(*) FILTER (WHERE day(s.trade_date) % 5 = 0 AND (day(s.trade_date) <> 10 AND i.symbol LIKE '60%')) AS n_missing, CASE WHEN day(s.trade_date) = 10 THEN 1 ELSE 0 END AS n_unexpected FROM instruments i JOIN sessions s ON {ALIVE} GROUP BY 1""")
def _(fx):
    live, _, days, listed = _status_inputs(fx)
    return D.status_presence(live, listed, days).select("trade_date", "n_missing", F.col("n_unexpected").cast("int").alias("n_unexpected"))


def _status_inputs(fx):
    """A live feed that drops one exchange's names on every fifth day of a month, but sends one name too many on the tenth."""
    days = kept(fx("sessions").select("trade_date"), "d45-days")
    listed = D.dealt(kept(fx("instruments").select("symbol", "list_date", "delist_date"), "d45-instruments"), days)
    alive = listed.join(F.broadcast(days), F.expr("(list_date IS NULL OR list_date <= trade_date) AND (delist_date IS NULL OR delist_date > trade_date)"))
    day = F.dayofmonth("trade_date")
    sent = alive.where((day % 5 != 0) | (day == 10) | ~F.col("symbol").startswith("60")).select("symbol", "trade_date")
    extra = days.where("day(trade_date) = 10").select(F.lit("999999.SH").alias("symbol"), "trade_date")
    live = sent.unionByName(extra).select("*", F.lit(True).alias("is_trading"), F.lit("normal").alias("status"), F.lit(False).alias("risk_warning"))
    history = fx("status").groupBy("symbol", "trade_date").agg(F.bool_or("is_trading").alias("is_trading"), F.max("status").alias("status"), F.bool_or("risk_warning").alias("risk_warning"))
    return live, history, days, listed


@query("d46_fill_gaps", "bars backup_bars", "SELECT symbol, trade_date, close FROM backup_bars UNION ALL SELECT b.symbol, b.trade_date, b.close FROM bars b ANTI JOIN backup_bars k ON b.symbol = k.symbol AND b.trade_date = k.trade_date")
def _(fx):
    return D.fill_gaps(fx("backup_bars").select(*KEY, "close"), fx("bars").select(*KEY, "close"), fx("bars").select(*KEY))


@query("d47_union_holders", "facts", """
WITH t AS (SELECT symbol, report_period AS record_date, item_code, CAST(NULL AS DATE) AS announce_date, 'total' AS holder_scope FROM facts), f AS (SELECT symbol, report_period AS record_date, item_code, announce_date, 'float' AS holder_scope FROM facts),
d AS (SELECT symbol, record_date, max(announce_date) AS d FROM f GROUP BY 1, 2)
SELECT DISTINCT symbol, record_date, item_code, announce_date, holder_scope FROM (SELECT t.symbol, t.record_date, t.item_code, d.d AS announce_date, t.holder_scope FROM t LEFT JOIN d ON t.symbol = d.symbol AND t.record_date = d.record_date UNION ALL SELECT * FROM f) x WHERE announce_date IS NOT NULL""")
def _(fx):
    base = fx("facts").select("symbol", F.col("report_period").alias("record_date"), "item_code", "announce_date")
    total = base.withColumn("announce_date", F.lit(None).cast("date")).withColumn("holder_scope", F.lit("total"))
    return D.union_holders(total, base.withColumn("holder_scope", F.lit("float")), ["symbol", "record_date", "item_code", "holder_scope", "announce_date"])


@query("d48_enrich_list_dates", "instruments spans", "SELECT i.symbol, coalesce(i.list_date, p.first_bar) AS list_date FROM instruments i LEFT JOIN spans p ON i.symbol = p.symbol")
def _(fx):
    return D.enrich_list_dates(fx("instruments"), fx("spans").select("symbol", F.col("first_bar").alias("list_date"))).select("symbol", "list_date")


@query("d49_symbol_priority", "announcements bars tick_days", """
WITH hot AS (SELECT symbol, volume AS place FROM bars WHERE volume > 45 AND trade_date = (SELECT max(trade_date) FROM bars WHERE volume > 45)),
u AS (SELECT symbol, 0 AS priority, CAST(place AS DOUBLE) AS place FROM hot UNION ALL SELECT symbol, 1, 0.0 FROM announcements WHERE announce_date = DATE '2024-01-10' UNION ALL SELECT symbol, 2, -amount FROM tick_days WHERE trade_date = DATE '2024-01-10' AND volume > 0),
b AS (SELECT symbol, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority, place) AS rn FROM u) x WHERE rn = 1)
SELECT symbol, priority FROM b ORDER BY priority, place, symbol LIMIT 60""")
def _(fx):
    hot = fx("bars").where("volume > 45").select("symbol", "trade_date", F.col("volume").alias("rank"))
    return D.symbol_priority(hot, fx("announcements"), fx("tick_days"), "2024-01-10", 60).select("symbol", "priority")


@query("d50_replace_covered", "bars backup_bars", "SELECT symbol, trade_date, close FROM bars WHERE trade_date NOT IN (SELECT trade_date FROM backup_bars WHERE close IS NULL) UNION ALL SELECT symbol, trade_date, close FROM backup_bars WHERE close IS NULL")
def _(fx):
    return D.replace_covered(fx("bars").select("trade_date", "symbol", "close"), fx("backup_bars").where("close IS NULL").select("trade_date", "symbol", "close"), "trade_date")


@query("d51_yearly_acceptance", "bars", "SELECT CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT trade_date) AS n_days FROM bars GROUP BY 1")
def _(fx):
    return D.yearly_acceptance(fx("bars"))


@query("d51_spot_check", "bars factors month_ends", """
SELECT b.symbol, b.trade_date, b.close, b.close * coalesce(f.factor, 1.0) AS adj_close, 'hfq' AS adjust_type FROM bars b LEFT JOIN factors f ON b.symbol = f.symbol AND b.trade_date = f.trade_date WHERE b.trade_date IN (SELECT as_of_date FROM month_ends)""")
def _(fx):
    picks = fx("bars").join(F.broadcast(fx("month_ends").select(F.col("as_of_date").alias("trade_date"))), "trade_date", "left_semi")
    return D.spot_check(fx("bars"), fx("factors"), picks)


@query("d52_split_by_source", "instruments", "SELECT symbol, CASE WHEN split_part(symbol, '.', 2) IN ('SH', 'SZ') THEN 'primary' ELSE 'fallback' END AS served_by FROM instruments")
def _(fx):
    return D.split_by_source(fx("instruments").select("symbol"))


@query("a20_pivot_items", "facts", """
SELECT symbol, report_period, max_by(item_value, (announce_date, data_version)) FILTER (item_code = 'item0') AS item0, max_by(item_value, (announce_date, data_version)) FILTER (item_code = 'item1') AS item1, max_by(item_value, (announce_date, data_version)) FILTER (item_code = 'item2') AS item2
FROM facts WHERE announce_date IS NOT NULL GROUP BY 1, 2""")
def _(fx):
    last = F.max_by("item_value", F.struct("announce_date", "data_version"))
    return fx("facts").where("announce_date IS NOT NULL").groupBy("symbol", "report_period").pivot("item_code", ["item0", "item1", "item2"]).agg(last)


@query("a23_month_end_sessions", "sessions", "SELECT max(trade_date) AS as_of_date FROM sessions GROUP BY year(trade_date), month(trade_date)")
def _(fx):
    return fx("sessions").groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("as_of_date")).select("as_of_date")


@query("a24_scoped_bounds", "bars instruments", f"""SELECT split_part(b.symbol, '.', 2) AS exchange, min(b.trade_date) AS lo, max(b.trade_date) AS hi FROM bars b JOIN instruments i ON b.symbol = i.symbol WHERE {universe_sql('b.symbol')}
  AND (i.list_date IS NULL OR i.list_date <= b.trade_date) AND (i.delist_date IS NULL OR b.trade_date <= i.delist_date) GROUP BY 1""")
def _(fx):
    from ..operators.universe import listed

    return listed(fx("bars"), fx("instruments")).groupBy(F.substring_index("symbol", ".", -1).alias("exchange")).agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))


@query("a8_action_terms", "actions", "SELECT symbol, ex_date, sum(cash_dividend) AS cash, sum(bonus_ratio) AS bonus FROM actions GROUP BY 1, 2")
def _(fx):
    return fx("actions").groupBy("symbol", "ex_date").agg(F.sum("cash_dividend").alias("cash"), F.sum("bonus_ratio").alias("bonus"))


@query("d28_historical_validity", "bars instruments status sessions spans", f"""
WITH listed AS (SELECT b.* FROM bars b JOIN instruments i ON b.symbol = i.symbol WHERE {universe_sql('b.symbol')} AND (i.list_date IS NULL OR i.list_date <= b.trade_date) AND (i.delist_date IS NULL OR b.trade_date <= i.delist_date))
SELECT 'st_evidence' AS blocker, (SELECT count(*) FROM (SELECT DISTINCT symbol, trade_date FROM listed) l ANTI JOIN status s ON s.symbol = l.symbol AND s.trade_date = l.trade_date) AS n
UNION ALL SELECT 'interior_sessions', (SELECT count(*) FROM sessions s ANTI JOIN listed l ON l.trade_date = s.trade_date)
UNION ALL SELECT 'delisted_universe', (SELECT count(*) FROM instruments i ANTI JOIN listed l ON l.symbol = i.symbol WHERE i.delist_date IS NOT NULL AND {universe_sql('i.symbol')})""")
def _(fx):
    from ..plans.reports import historical_validity

    return historical_validity(fx("bars"), fx("instruments"), fx("status"), fx("sessions"))


@query("d12_recovered_instruments", "instruments valuations spans", """
WITH d AS (SELECT DISTINCT symbol, 'gone ' || symbol AS name, CAST(NULL AS DATE) AS delist_date FROM valuations WHERE symbol NOT IN (SELECT symbol FROM instruments) UNION ALL SELECT symbol, name, last_bar FROM (SELECT i.symbol, i.name, p.last_bar FROM instruments i JOIN spans p ON i.symbol = p.symbol WHERE p.n_bars > 540) x)
SELECT i.symbol, i.name, i.list_date, coalesce(i.delist_date, d.delist_date) AS delist_date FROM instruments i LEFT JOIN d ON i.symbol = d.symbol
UNION ALL SELECT d.symbol, d.name, p.first_bar, coalesce(d.delist_date, p.last_bar) FROM d LEFT JOIN spans p ON d.symbol = p.symbol WHERE d.symbol NOT IN (SELECT symbol FROM instruments)""")
def _(fx):
    i, p = fx("instruments"), fx("spans")
    unknown = fx("valuations").select("symbol").distinct().join(i.select("symbol"), "symbol", "left_anti")
    unknown = unknown.select("symbol", F.concat(F.lit("gone "), "symbol").alias("name"), F.lit(None).cast("date").alias("delist_date"))
    known = i.join(p.where("n_bars > 540"), "symbol").select("symbol", "name", F.col("last_bar").alias("delist_date"))
    return D.recovered_instruments(i, unknown.unionByName(known), p)


@query("d40_announcement_window", "announcements", """
WITH h AS (SELECT DISTINCT announce_date FROM announcements), s AS (SELECT greatest(min(announce_date), DATE '2023-12-01') AS lo, least(max(announce_date), DATE '2024-02-15') AS hi FROM h),
d AS (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events) SELECT lo, hi, (SELECT count(*) FROM d, s WHERE d.trade_date BETWEEN s.lo AND s.hi AND d.trade_date NOT IN (SELECT announce_date FROM h)) AS n_holes FROM s""")
def _(fx):
    days = fx("events").select(F.col("ts").cast("date").alias("trade_date")).distinct()
    return D.announcement_window(fx("announcements"), days, "2023-12-01", "2024-02-15")


@query("d44_retract_derived", "instruments sessions", """
WITH s AS (SELECT i.symbol, x.trade_date, CASE WHEN day(x.trade_date) <= 15 THEN 'derived_delisted' ELSE 'eastmoney' END AS source FROM instruments i JOIN sessions x ON x.trade_date > i.delist_date)
SELECT s.symbol, s.trade_date, s.source FROM s LEFT JOIN instruments i ON s.symbol = i.symbol WHERE s.source <> 'derived_delisted' OR s.trade_date > i.delist_date + INTERVAL 60 DAY""")
def _(fx):
    rows = D.life_status(fx("instruments"), fx("sessions")).where("status = 'delisted'")
    rows = rows.select("symbol", "trade_date", F.when(F.dayofmonth("trade_date") <= 15, "derived_delisted").otherwise("eastmoney").alias("source"))
    return D.retract_derived(rows, fx("instruments").select("symbol", F.date_add("delist_date", 60).alias("delist_date")))
