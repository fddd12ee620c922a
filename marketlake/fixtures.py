"""Market-shaped views over the driver's generic tables, as SQL that Spark and DuckDB both run.

``{table}`` stands for a base table; other names are fixtures. Three calls have a spelling per engine: WEEKDAY0 (Monday is 0), MONTH_END and DAYS (days from a to b).

A symbol's code has four digits of a key, so that longer keys share symbols. Keys of the fixtures are (symbol, day) all the same, as the contracts demand: ``bars`` joins the lines
of all suppliers of a symbol, and ``listings`` names a symbol after the first of them.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SYMBOL = (
    "CASE WHEN {k} % 20 = 19 THEN concat('51', lpad(CAST({k} AS STRING), 4, '0'), '.SH') WHEN {k} % 4 = 0 THEN concat('60', lpad(CAST({k} AS STRING), 4, '0'), '.SH') "
    "WHEN {k} % 4 = 1 THEN concat('00', lpad(CAST({k} AS STRING), 4, '0'), '.SZ') WHEN {k} % 4 = 2 THEN concat('30', lpad(CAST({k} AS STRING), 4, '0'), '.SZ') "
    "ELSE concat('83', lpad(CAST({k} AS STRING), 4, '0'), '.BJ') END"
)


def symbol_sql(k: str) -> str:
    return _SYMBOL.replace("{k}", k)


FIXTURES: dict[str, str] = {
    "bars": f"""
      SELECT symbol, d AS trade_date, max(CASE WHEN r = 1 THEN p END) AS open, max(p) AS high, min(p) AS low,
        max(CASE WHEN z = 1 THEN p END) AS close, CAST(sum(q) AS BIGINT) AS volume, round(sum(a), 2) AS amount
      FROM (SELECT symbol, d, l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS a,
          row_number() OVER (PARTITION BY symbol, d ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS r,
          row_number() OVER (PARTITION BY symbol, d ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS z
        FROM (SELECT *, {symbol_sql("l_suppkey")} AS symbol, CAST(l_shipdate AS DATE) AS d FROM {{lineitem}}) t) px GROUP BY symbol, d""",
    "bars_raw": """
      SELECT symbol, trade_date, open, high, low, close, CASE WHEN volume % 7 = 0 THEN CAST(0 AS BIGINT) ELSE volume END AS volume,
        CASE WHEN volume % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE amount END AS amount,
        'tdx_protocol' AS source, 'v2' AS data_version, CAST(trade_date AS TIMESTAMP) + INTERVAL '17' HOUR AS fetched_at FROM bars
      UNION ALL
      SELECT symbol, trade_date, open, high, low, close * 1.01, volume, amount,
        'baostock', 'v1', CASE WHEN volume % 2 = 0 THEN CAST(trade_date AS TIMESTAMP) + INTERVAL '17' HOUR ELSE CAST(trade_date AS TIMESTAMP) + INTERVAL '18' HOUR END FROM bars WHERE volume > 35""",
    "calendar": "SELECT trade_date, WEEKDAY0(trade_date) < 5 AS is_trading FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM {lineitem}) days",
    "sessions": "SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM calendar WHERE is_trading",
    "spans": "SELECT symbol, min(trade_date) AS first_bar, max(trade_date) AS last_bar, count(*) AS n_bars FROM bars GROUP BY symbol",
    "listings": f"""
      SELECT k, symbol, name, nation FROM (SELECT s_suppkey AS k, symbol, s_name AS name, s_nationkey AS nation, row_number() OVER (PARTITION BY symbol ORDER BY s_suppkey, s_name) AS r
        FROM (SELECT *, {symbol_sql("s_suppkey")} AS symbol FROM {{supplier}}) t) s WHERE r = 1""",
    "instruments": """
      SELECT s.symbol, s.name, substring(s.symbol, 8, 2) AS exchange, CASE WHEN s.symbol LIKE '51%' THEN 'etf' ELSE 'stock' END AS asset_type,
        CASE WHEN s.k % 7 = 0 THEN CAST(NULL AS DATE) ELSE p.first_bar END AS list_date,
        CASE WHEN s.k % 5 = 0 THEN CAST(p.last_bar - INTERVAL '200' DAY AS DATE) END AS delist_date, CAST(NULL AS STRING) AS prev_symbol
      FROM (SELECT k, symbol, CASE WHEN k % 9 = 0 THEN concat('*ST', name) ELSE name END AS name FROM listings) s
      LEFT JOIN spans p ON s.symbol = p.symbol""",
    "status": """
      SELECT symbol, trade_date, volume % 11 <> 0 AS is_trading, CASE WHEN volume % 11 = 0 THEN 'suspended' WHEN volume % 23 = 0 THEN 'st' ELSE 'normal' END AS status,
        CASE WHEN volume % 13 = 0 THEN true WHEN volume % 3 = 0 THEN CAST(NULL AS BOOLEAN) ELSE false END AS risk_warning,
        CASE WHEN volume % 4 = 0 THEN 'eastmoney' WHEN volume % 4 = 1 THEN 'derived_bar_gap' WHEN volume % 4 = 2 THEN 'eastmoney_cached' ELSE 'baostock' END AS source,
        'v1' AS data_version, CAST(trade_date AS TIMESTAMP) + (volume % 12) * INTERVAL '1' HOUR AS fetched_at
      FROM bars WHERE volume < 30
      UNION ALL
      SELECT symbol, trade_date, true, 'normal', false, 'eastmoney', 'v1', CAST(trade_date AS TIMESTAMP) + INTERVAL '30' HOUR FROM bars WHERE volume < 10""",
    "factor_events": f"""
      SELECT symbol, ex_date, 'hfq' AS adjust_type, CAST(1 AS DOUBLE) + CAST(row_number() OVER (PARTITION BY symbol ORDER BY ex_date) AS DOUBLE) / 20 AS factor
      FROM (SELECT DISTINCT {symbol_sql("k")} AS symbol, ex_date FROM (
        SELECT o_custkey % (SELECT count(*) FROM {{supplier}}) AS k, CAST(o_orderdate AS DATE) AS ex_date FROM {{orders}} WHERE o_orderpriority LIKE '1%') x) e""",
    "factors": """
      SELECT b.symbol, b.trade_date, 'hfq' AS adjust_type, e.factor FROM bars b JOIN (
        SELECT symbol, ex_date, factor, lead(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date) AS until FROM factor_events) e
      ON b.symbol = e.symbol AND b.trade_date >= e.ex_date AND (e.until IS NULL OR b.trade_date < e.until)""",
    "actions": f"""
      SELECT symbol, ex_date, action_type, sum(cash) AS cash_dividend, sum(bonus) AS bonus_ratio, CAST(0 AS DOUBLE) AS transfer_ratio, CAST(0 AS DOUBLE) AS allotment_ratio, CAST(NULL AS DOUBLE) AS allotment_price
      FROM (SELECT {symbol_sql("k")} AS symbol, ex_date, CASE WHEN o % 40 = 0 THEN 'dividend' ELSE 'bonus' END AS action_type,
          CASE WHEN o % 40 = 0 THEN CAST(o % 7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cash, CASE WHEN o % 40 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o % 5 AS DOUBLE) / 10 END AS bonus
        FROM (SELECT o_custkey % (SELECT count(*) FROM {{supplier}}) AS k, o_orderkey AS o, CAST(o_orderdate AS DATE) AS ex_date FROM {{orders}} WHERE o_orderpriority LIKE '1%') x) y
      GROUP BY symbol, ex_date, action_type""",
    "facts": f"""
      SELECT {symbol_sql("o_custkey % 1000")} AS symbol, concat(CAST(year(o_orderdate) AS STRING), 'Q', CAST(quarter(o_orderdate) AS STRING)) AS report_period,
        'income' AS statement_type, concat('item', CAST(o_custkey % 3 AS STRING)) AS item_code, CASE WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS announce_date,
        o_totalprice AS item_value, CASE WHEN o_orderkey % 13 = 0 THEN 'vendor_backfill' ELSE 'eastmoney' END AS source, concat('r', CAST(o_orderkey AS STRING)) AS data_version,
        CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 90) * INTERVAL '1' DAY AS fetched_at FROM {{orders}}""",
    "members": """
      SELECT symbol, 'sw' AS classification_system, concat('2', CAST((nation + a.i) % 5 AS STRING), lpad(CAST(nation AS STRING), 2, '0'), '01') AS industry_code,
        concat('industry', CAST(nation AS STRING)) AS industry_name, a.as_of_date, CASE WHEN k % 10 = 0 THEN 'other' ELSE 'sw' END AS source
      FROM listings CROSS JOIN (SELECT 0 AS i, DATE '1995-01-31' AS as_of_date UNION ALL SELECT 1, DATE '1997-06-30' UNION ALL SELECT 2, DATE '1999-12-31') a""",
    "intervals": """
      SELECT symbol, concat('2', CAST((nation + a.i) % 5 AS STRING), lpad(CAST(nation AS STRING), 2, '0'), '01') AS industry_code,
        CAST(a.d + (k % 50) * INTERVAL '1' DAY AS DATE) AS start_date, CASE WHEN k % 4 = 0 THEN CAST(NULL AS DATE) ELSE CAST(a.d + (k % 50 + 300) * INTERVAL '1' DAY AS DATE) END AS end_date
      FROM listings CROSS JOIN (SELECT 0 AS i, DATE '1995-03-01' AS d UNION ALL SELECT 1, DATE '1997-02-01' UNION ALL SELECT 2, DATE '1999-04-01') a""",
    "month_ends": "SELECT max(trade_date) AS as_of_date FROM calendar WHERE is_trading GROUP BY year(trade_date), month(trade_date)",
    "ticks": f"""
      SELECT {symbol_sql("user_id % 100")} AS symbol, CAST(ts AS DATE) AS trade_date, CAST(row_number() OVER (PARTITION BY user_id % 100, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS tick_seq,
        ts AS trade_time, value AS price, CAST(100 * (1 + event_id % 9) AS BIGINT) AS volume, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'sell' ELSE 'neutral' END AS direction, event_id FROM {{events}}""",
    "tick_days": """
      SELECT symbol, trade_date, CAST(sum(volume) AS BIGINT) + CAST(min(event_id) % 2 AS BIGINT) AS volume, round(sum(price * volume), 4) AS amount FROM ticks GROUP BY symbol, trade_date""",
    "minute_bars": """
      SELECT symbol, trade_date, m + INTERVAL '1' MINUTE AS bar_time, '1m' AS frequency, max(CASE WHEN r = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
        max(CASE WHEN z = 1 THEN price END) AS close, CAST(sum(volume) AS BIGINT) AS volume, round(sum(price * volume), 4) AS amount
      FROM (SELECT symbol, trade_date, date_trunc('minute', trade_time) AS m, price, volume,
          row_number() OVER (PARTITION BY symbol, date_trunc('minute', trade_time) ORDER BY tick_seq) AS r, row_number() OVER (PARTITION BY symbol, date_trunc('minute', trade_time) ORDER BY tick_seq DESC) AS z FROM ticks) t
      GROUP BY symbol, trade_date, m""",
    "announcements": f"""
      SELECT concat('a', CAST(doc_id AS STRING)) AS announcement_id, {symbol_sql("doc_id % 100")} AS symbol, text AS title,
        CAST(DATE '2024-01-01' + (doc_id % 60) * INTERVAL '1' DAY AS DATE) AS announce_date, lang AS category FROM {{documents}}""",
    "headlines": f"""
      SELECT concat('n', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS news_id, CAST(DATE '2024-01-01' + (conv_id % 60) * INTERVAL '1' DAY AS DATE) AS publish_date, text AS title,
        concat({symbol_sql("conv_id % 100")}, '; ', lower({symbol_sql("(conv_id + 7) % 100")}), ',bad') AS related_symbols, role AS channel FROM {{conversations}}""",
    "backup_bars": """
      SELECT symbol, trade_date, open, high, low, CASE WHEN volume % 19 = 0 THEN close * 1.02 WHEN volume % 29 = 0 THEN CAST(NULL AS DOUBLE) ELSE close END AS close, volume, amount FROM bars WHERE volume > 2""",
    "thinned_bars": "SELECT * FROM bars WHERE volume > 20 OR month(trade_date) % 2 = 0",
    "large_bars": "SELECT * FROM bars WHERE volume > 30",
    "rare_bars": "SELECT * FROM bars WHERE volume > 48",
    "late_bars": "SELECT * FROM bars WHERE trade_date <> (SELECT CAST(min(trade_date) + INTERVAL '1000' DAY AS DATE) FROM calendar) AND trade_date <> (SELECT CAST(min(trade_date) + INTERVAL '1002' DAY AS DATE) FROM calendar)",
    "few_actions": "SELECT * FROM actions WHERE month(ex_date) > 6",
    "odd_amounts": """
      SELECT symbol, trade_date, source, CASE WHEN volume % 37 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN volume % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE amount END AS amount FROM bars_raw""",
    "holed_ticks": "SELECT * FROM ticks WHERE direction <> 'neutral' OR tick_seq > 20",
    "valuations": """
      SELECT symbol, trade_date, close / 3 AS pe_ttm, close * 1000 AS total_mv FROM bars WHERE volume > 12
      UNION ALL SELECT concat('99', substring(symbol, 3, 7)), trade_date, close, close FROM bars WHERE volume > 45""",
    "macro": """
      SELECT concat('m', CAST(o_custkey % 4 AS STRING)) AS indicator_id, MONTH_END(o_orderdate) AS obs_date, round(avg(o_totalprice), 2) AS value, 'monthly' AS frequency
      FROM {orders} GROUP BY 1, 2""",
    "boards": """
      SELECT concat('BK', lpad(CAST(k AS STRING), 4, '0')) AS sector_code, concat(p_brand, ' ', p_type, CASE WHEN k % 3 = 0 THEN '概念' ELSE ' 板块' END) AS sector_name,
        CASE WHEN k % 2 = 0 THEN 'industry' ELSE 'concept' END AS board_type FROM (SELECT p_brand, p_type, min(p_partkey) AS k FROM {part} GROUP BY p_brand, p_type) x""",
    "board_indices": """
      SELECT concat('88', lpad(CAST(k AS STRING), 4, '0')) AS tdx_code, CASE WHEN k % 4 = 0 THEN concat(p_brand, p_type) WHEN k % 4 = 1 THEN concat(p_brand, ' ', p_type, ' x') ELSE concat(p_type, CAST(p_size AS STRING)) END AS name
      FROM (SELECT p_brand, p_type, p_size, min(p_partkey) AS k FROM {part} GROUP BY p_brand, p_type, p_size) x""",
}

#: The same rows as Spark takes them in one pass: one sort of the lines for both ends of a day, and one derivation of the bars that several rows come from. Rows that stem
#: from one bar stay in its task, so that a grouping by (symbol, day) needs no second shuffle.
SPARK: dict[str, str] = {
    "bars": f"""
      SELECT symbol, d AS trade_date, max(o) AS open, max(p) AS high, min(p) AS low, max(c) AS close, CAST(sum(q) AS BIGINT) AS volume, round(sum(a), 2) AS amount
      FROM (SELECT symbol, d, p, q, a, first_value(p) OVER w AS o, last_value(p) OVER w AS c
        FROM (SELECT {symbol_sql("l_suppkey")} AS symbol, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS a, l_orderkey, l_linenumber, l_partkey
          FROM {{lineitem}}) t
        WINDOW w AS (PARTITION BY symbol, d ORDER BY l_orderkey, l_linenumber, l_partkey, a, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) px GROUP BY symbol, d""",
    "bars_raw": """
      SELECT symbol, trade_date, open, high, low, CASE WHEN i = 0 THEN close ELSE close * 1.01 END AS close, CASE WHEN i = 0 AND volume % 7 = 0 THEN CAST(0 AS BIGINT) ELSE volume END AS volume,
        CASE WHEN i = 0 AND volume % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE amount END AS amount, CASE WHEN i = 0 THEN 'tdx_protocol' ELSE 'baostock' END AS source,
        CASE WHEN i = 0 THEN 'v2' ELSE 'v1' END AS data_version, CAST(trade_date AS TIMESTAMP) + CASE WHEN i = 0 OR volume % 2 = 0 THEN INTERVAL '17' HOUR ELSE INTERVAL '18' HOUR END AS fetched_at
      FROM bars LATERAL VIEW explode(CASE WHEN volume > 35 THEN array(0, 1) ELSE array(0) END) e AS i""",
    "status": """
      SELECT symbol, trade_date, i = 1 OR volume % 11 <> 0 AS is_trading, CASE WHEN i = 1 THEN 'normal' WHEN volume % 11 = 0 THEN 'suspended' WHEN volume % 23 = 0 THEN 'st' ELSE 'normal' END AS status,
        CASE WHEN i = 1 THEN false WHEN volume % 13 = 0 THEN true WHEN volume % 3 = 0 THEN CAST(NULL AS BOOLEAN) ELSE false END AS risk_warning,
        CASE WHEN i = 1 OR volume % 4 = 0 THEN 'eastmoney' WHEN volume % 4 = 1 THEN 'derived_bar_gap' WHEN volume % 4 = 2 THEN 'eastmoney_cached' ELSE 'baostock' END AS source,
        'v1' AS data_version, CAST(trade_date AS TIMESTAMP) + CASE WHEN i = 1 THEN 30 ELSE volume % 12 END * INTERVAL '1' HOUR AS fetched_at
      FROM bars LATERAL VIEW explode(CASE WHEN volume < 10 THEN array(0, 1) ELSE array(0) END) e AS i WHERE volume < 30""",
    "valuations": """
      SELECT CASE WHEN i = 0 THEN symbol ELSE concat('99', substring(symbol, 3, 7)) END AS symbol, trade_date, CASE WHEN i = 0 THEN close / 3 ELSE close END AS pe_ttm,
        CASE WHEN i = 0 THEN close * 1000 ELSE close END AS total_mv
      FROM bars LATERAL VIEW explode(CASE WHEN volume > 45 THEN array(0, 1) ELSE array(0) END) e AS i WHERE volume > 12""",
}

#: Folders where the fixtures of a folder of test tables were written once, by that folder (see ``store``).
STORED: dict[str, str] = {}
_NAME = re.compile(r"\b(" + "|".join(FIXTURES) + r")\b")


@cache
def closure(names: tuple[str, ...]) -> tuple[str, ...]:
    """The fixtures that these need, each after those it reads."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", FIXTURES[name])):
            if inner in FIXTURES and inner != name:
                add(inner)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return tuple(order)


def with_clause(names: tuple[str, ...], forms: dict[str, str] = FIXTURES) -> str:
    return ", ".join(f"{n} AS ({forms[n]})" for n in closure(names))


def duckdb(names: tuple[str, ...]) -> str:
    text = re.sub(r"\{(\w+)\}", r"\1", with_clause(names))
    text = re.sub(r"WEEKDAY0\((\w+)\)", r"(isodow(\1) - 1)", text)
    return re.sub(r"MONTH_END\((\w+)\)", r"last_day(\1)", text)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a base table, as a DataFrame."""
    if sf_dir in STORED and name in FIXTURES:
        return spark.read.parquet(f"{STORED[sf_dir]}/{name}")
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = with_clause((name,), FIXTURES | SPARK).replace("WEEKDAY0(", "weekday(").replace("MONTH_END(", "last_day(")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **tables)


def store(spark: SparkSession, sf_dir: str, root: str, names: tuple[str, ...] = tuple(FIXTURES)) -> None:
    """Writes fixtures as tables under ``root``; from then on queries over ``sf_dir`` read these, as a lake's user would, and do not derive them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        frame(spark, sf_dir, name).write.mode("overwrite").parquet(f"{root}/{name}")
    STORED[sf_dir] = root
