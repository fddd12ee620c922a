"""Fixtures as Spark derives them: the rows of their SQL, in one pass, in tasks that do not grow with the input."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from marketlake import fixtures
from marketlake.plans import derive
from marketlake.plans import quality as Q

SOURCE = "/root/testdata/sf0.001"
LINES = "lineitem.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet .*?" + LINES, plan(df)))


@pytest.mark.parametrize("name", sorted(fixtures.SPARK))
def test_one_pass_forms_equal_their_sql(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = fixtures.frame(spark, SOURCE, name).withColumns({c: F.col(c).cast("string") for c, t in fixtures.frame(spark, SOURCE, name).dtypes if t in ("timestamp", "date")})
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SOURCE}/{LINES}'")
        want = c.execute(f"WITH {fixtures.duckdb((name,))} SELECT * FROM {name}")
        columns = [d[0] for d in want.description]
        want = sorted((tuple(str(v) if isinstance(v, dt.date) else v for v in r) for r in want.fetchall()), key=repr)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["bars_raw", "status", "valuations"])
def test_rows_of_one_bar_come_from_one_derivation(spark, name):
    assert scans(fixtures.frame(spark, SOURCE, name)) == 1


def test_pairs_need_no_second_shuffle(spark):
    assert plan(queries()["u4_distinct_pairs"](spark, SOURCE)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["q41_audit", "q34_unverified_pairs", "d4_symbols_to_refresh", "u4_distinct_pairs"])
def test_shuffles_begin_with_many_partitions(spark, name):
    # Coalesced by size, not split: with 200 of them a task grew with the input.
    dealt = re.findall(r"hashpartitioning\(.*?, (\d+)\), ENSURE_REQUIREMENTS", plan(queries()[name](spark, SOURCE)))
    assert dealt and {int(n) for n in dealt} == {2000}


def test_splits_of_a_scan_are_small(spark, tmp_path):
    queries()["u4_distinct_pairs"](spark, SOURCE)
    spark.range(6_000_000).selectExpr("id", "xxhash64(id) AS h", "xxhash64(h) AS g").coalesce(1).write.option("compression", "none").option("parquet.block.size", 4 << 20).parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert size > 100 << 20
    assert spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() >= size // (16 << 20)


def test_quarantine_is_counted_in_one_pass(spark):
    found = queries()["p12_cast_quarantine"](spark, SOURCE)
    assert scans(found) == 1
    assert "lambda" not in plan(found)


@pytest.mark.parametrize("name", ["d45_assemble_status", "d45_status_presence"])
def test_status_inputs_are_derived_once(spark, name):
    assert scans(queries()[name](spark, SOURCE)) == 0


def test_instruments_are_dealt_by_the_rows_they_make(spark):
    instruments, days = spark.range(20).selectExpr("CAST(id AS STRING) AS symbol").coalesce(1), spark.range(10)
    assert derive.dealt(instruments, days, rows=50).rdd.getNumPartitions() == 5


def test_volume_unit_reads_its_bars_once(spark, tmp_path):
    rows = [("lots", 10.0, 5, 10.0 * 5 * 100)] * 250
    spark.createDataFrame(rows, "source string, close double, volume bigint, amount double").write.parquet(f"{tmp_path}/bars")
    found = Q.volume_unit(spark.read.parquet(f"{tmp_path}/bars"))
    assert str(tmp_path) not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("lots", 100.0, 250)]
