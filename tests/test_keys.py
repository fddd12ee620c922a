"""Suppliers whose keys have more digits than a symbol's code: several share a symbol, and (symbol, day) is a key all the same."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from marketlake import fixtures

SOURCE = "/root/testdata/sf0.01"
QUERIES = """m5_delta_chain a16_filtered_aggregates a1_canonical_rows a1_status_evidence a3_monthly_bars a3_weekly_bars a6_group_returns d14_calibrate_st d1_market_breadth
  d20_survivorship_gap d21_symbol_summary d22_daily_kline_page d8_delisting_events d9_industry_members_history j10_expand_open""".split()


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The test tables with five-digit supplier keys; the last supplier's key is 1000, whose symbol is that of 10000."""
    root = str(tmp_path_factory.mktemp("wide"))
    with duckdb.connect() as c:
        for table, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
            c.execute(f"COPY (SELECT * REPLACE (CASE WHEN {key} = 99 THEN 1000 ELSE 10000 + {key} END AS {key}) FROM '{SOURCE}/{table}.parquet') TO '{root}/{table}.parquet' (FORMAT parquet)")
    for name in os.listdir(SOURCE):
        if not os.path.exists(f"{root}/{name}"):
            os.symlink(f"{SOURCE}/{name}", f"{root}/{name}")
    return root


@pytest.mark.parametrize("name, key", [("bars", "symbol, trade_date"), ("instruments", "symbol"), ("members", "symbol, as_of_date"), ("intervals", "symbol, start_date")])
def test_fixture_keys_are_unique(spark, wide, name, key):
    rows = fixtures.frame(spark, wide, name)
    assert rows.count() == rows.select(*key.split(", ")).distinct().count() > 0


def test_bars_hold_the_lines_of_all_suppliers_of_a_symbol(spark, wide):
    total = spark.read.parquet(f"{wide}/lineitem.parquet").selectExpr("CAST(sum(l_quantity) AS BIGINT)").first()[0]
    assert fixtures.frame(spark, wide, "bars").selectExpr("sum(volume)").first()[0] == total


def _text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_agree_with_their_sql(spark, wide, name):
    found = queries()[name](spark, wide)
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for file in os.listdir(wide):
            c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{wide}/{file}'")
        want = c.execute(oracle_sql()[name])
        columns = [d[0] for d in want.description]
        want = sorted(tuple(map(_text, r)) for r in want.fetchall())
    assert sorted(tuple(map(_text, r)) for r in found.select(columns).collect()) == want


def test_universe_patterns(spark):
    """Patterns of one mention class symbols as prefixes, bands and exchanges do, and mention the symbol once."""
    from pyspark.sql import functions as F

    from marketlake.functions import symbols as S

    codes = [f"{p:02d}{tail}" for p in range(100) for tail in ("0001", "9001", "00011", "000")] + ["689009", "6", "", "60.001"]
    rows = [(f"{c}{e}",) for c in codes for e in (".SH", ".SZ", ".BJ", ".sh", ".Sz", ".XX", "")] + [(None,)]
    c, e = S.code(F.col("symbol")), S.exchange(F.col("symbol"))
    out = (e.isin("SH", "SZ") & S.starts(c, S.RESERVED)) | ((e == "SH") & S.starts(c, S.CDR)) | S._any_exchange(c, e, S.ETF)
    plain = S._any_exchange(c, e, S.PREFIXES) & ~out
    etf = F.coalesce(S._six_digits(c) & S._any_exchange(c, e, S.ETF), F.lit(False))
    df = spark.createDataFrame(rows, "symbol string")
    got = df.select(S.in_universe(F.col("symbol")).eqNullSafe(plain), S.in_universe(F.col("symbol"), "all_a_sh_sz").eqNullSafe(plain & e.isin("SH", "SZ")), S.is_etf(c, e).eqNullSafe(etf))
    assert got.distinct().collect() == [(True, True, True)]
    plan = df.where(S.in_universe(F.col("symbol")))._jdf.queryExecution().analyzed().toString()
    assert plan.split("Filter", 1)[1].split("\n")[0].count("symbol") == 1


def test_digests_sum_halves_exactly(spark, wide):
    """The digest is the exact sum of 60-bit halves, and generations and digests derive the bars once."""
    from marketlake.operators.digest import business_columns, of_frame, row_halves

    b = fixtures.frame(spark, wide, "bars").localCheckpoint()
    halves = b.select(*row_halves(business_columns(b))).collect()
    d = of_frame(b)
    assert (d.n_rows, d.a, d.b) == (len(halves), sum(int(r[0]) for r in halves), sum(int(r[1]) for r in halves)) and d.a > 1 << 63
    assert of_frame(b.where("false")).a == 0


@pytest.mark.parametrize("name", ["m2_digest_adds_up", "m6_generations"])
def test_bars_are_derived_once(spark, wide, name):
    from marketlake.queries.core import QUERIES

    asked = []
    QUERIES[name][0](lambda table: asked.append(table) or fixtures.frame(spark, wide, table))
    assert asked.count("bars") == 1


def test_partition_size_is_bounded_unless_set(spark):
    from marketlake.queries.core import PARTITION_SIZE, runner

    name, size = PARTITION_SIZE
    was = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        runner(lambda fx: None)(spark, SOURCE)
        assert spark.conf.get(name) == size
        spark.conf.set(name, "32m")
        runner(lambda fx: None)(spark, SOURCE)
        assert spark.conf.get(name) == "32m"
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
