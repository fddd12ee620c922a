"""The semantic reader over a small written lake; the cases are those of the reader's contract."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketlake.operators.universe import UniverseCoverageError
from marketlake.registry import dataset
from marketlake.sources import lake
from marketlake.sources.reader import Lake, ReaderError, contract_order, quarantine

DAY, AT = date(2024, 6, 27), datetime(2024, 6, 27, 18)
SYMBOLS = ("600519.SH", "000001.SZ", "300750.SZ")


@pytest.fixture()
def home(spark, tmp_path):
    home = Lake(spark, str(tmp_path))
    stamp = ("tdx_protocol", "v1", AT)

    def put(name, rows):
        lake.write_partitions(spark.createDataFrame([(*r, *stamp) for r in rows], dataset(name).schema), home.path(name), dataset(name).partition, dataset(name).granularity)

    put("daily_bars", [(s, DAY, 10.0, 11.0, 9.0, c, 100, 1000.0) for s, c in zip(SYMBOLS, (10.5, 20.5, 30.5))])
    put("trading_status", [(SYMBOLS[0], DAY, True, "normal", False), (SYMBOLS[1], DAY, True, "st", True), (SYMBOLS[2], DAY, False, "suspended", False)])
    put("adj_factors", [(SYMBOLS[0], DAY, "hfq", 2.0), (SYMBOLS[1], DAY, "hfq", 3.0)])
    listed = [(s, "n", s[-2:], "stock", date(2010, 1, 1), None, None, *stamp) for s in SYMBOLS]
    spark.createDataFrame(listed, dataset("instruments").schema).write.parquet(home.path("instruments"))
    facts = [("600519.SH", "2024Q1", "income", "np", v, date.fromisoformat(a), s, "v1", datetime.fromisoformat(f)) for v, a, s, f in ((100.0, "2024-04-20", "em", "2024-04-20"), (90.0, "2025-03-15", "em", "2025-03-15"), (80.0, "2023-01-01", "x_backfill", "2025-05-01"))]
    lake.write_partitions(spark.createDataFrame(facts, dataset("financial_statement_items").schema).withColumn("day", F.lit(DAY)), home.path("financial_statement_items") + "_raw", "day", "year")
    spark.createDataFrame(facts, dataset("financial_statement_items").schema).withColumn("p_report_period", F.col("report_period")).write.partitionBy("p_report_period").parquet(home.path("financial_statement_items"))
    return home


def test_adjustment(home):
    got = {r["symbol"]: (r["adj_close"], r["adj_is_exact"], r["factor"]) for r in home.load("daily_bars", adjust="hfq").collect()}
    assert got == {"600519.SH": (21.0, True, 2.0), "000001.SZ": (61.5, True, 3.0), "300750.SZ": (30.5, False, 1.0)}
    with pytest.raises(ValueError):
        home.load("daily_bars", adjust="hfq", strict_adj=True)
    with pytest.raises(ReaderError):
        home.load("daily_bars", adjust="both")


def test_universe(home):
    assert [r["symbol"] for r in home.load("daily_bars", universe="all_a").collect()] == ["600519.SH"]
    assert home.load("daily_bars", profile="research_all_a").count() == 1
    late = home.spark.createDataFrame([("600000.SH", DAY, 1.0, 1.0, 1.0, 1.0, 1, 1.0, "tdx_protocol", "v1", AT)], dataset("daily_bars").schema)
    listed = home.spark.createDataFrame([("600000.SH", "n", "SH", "stock", date(2010, 1, 1), None, None, "s", "v1", AT)], dataset("instruments").schema)
    listed.write.mode("append").parquet(home.path("instruments"))
    lake.compact(home.spark, late, home.path("daily_bars"), ["symbol", "trade_date"], "trade_date", "day")
    with pytest.raises(UniverseCoverageError):
        home.load("daily_bars", universe="all_a", strict_universe=True)
    for bad in ({"name": "fund_flow", "universe": "all_a"}, {"name": "daily_bars", "profile": "none"}, {"name": "nothing"}, {"name": "daily_bars", "revision": 7}):
        with pytest.raises(ReaderError):
            home.load(**bad)


def test_point_in_time(home):
    values = lambda **k: sorted(r["item_value"] for r in home.load("financial_statement_items", **k).collect())
    assert values(as_of="2024-06-30") == [100.0] and values(as_of="2025-06-30") == [90.0]
    assert values(as_of="2025-06-30", all_vintages=True, pit_mode="strict") == [90.0, 100.0]
    assert values(as_of="2024-06-30", all_vintages=True, pit_mode="best_effort") == [80.0, 100.0]
    assert values(as_of="2025-06-30", start="2024-04-01") == [] and values(as_of="2025-06-30", items=["other"]) == []
    with pytest.raises(ReaderError):
        home.load("financial_statement_items")


def test_revisions_and_state(home):
    gens = lake.Generations(home.spark, home.path("index_bars"))
    row = ("000300.SH", DAY, 1.0, 1.0, 1.0, 1.0, 1, 1.0, "1d", "s", "v1", AT)
    gens.commit(home.spark.createDataFrame([row], dataset("index_bars").schema))
    gens.commit(home.spark.createDataFrame([row, (*row[:1], date(2024, 6, 28), *row[2:])], dataset("index_bars").schema))
    assert home.load("index_bars").count() == 2 and home.load("index_bars", revision=1).count() == 1
    assert home.load("index_bars", revision_map={"index_bars": 1}).count() == 1
    state = home.state("index_bars").collect()
    assert [(r["dataset"], r["revision"], r["n_rows"]) for r in state] == [("index_bars", 2, 2)] and home.state("fund_flow").isEmpty()
    with pytest.raises(ReaderError):
        home.load("index_bars", revision=1, revision_map={})


def test_views_orders_and_empty_datasets(home):
    home.register_views()
    assert home.spark.sql("SELECT * FROM daily_bars_adj").count() == 3 and home.spark.sql("SELECT * FROM hot_rank").isEmpty()
    assert home.load("hot_rank").columns == dataset("hot_rank").schema.names
    assert contract_order(dataset("trade_ticks").empty(home.spark)) == ["symbol", "trade_date", "tick_seq"]
    assert contract_order(dataset("minute_bars").empty(home.spark)) == ["symbol", "bar_time"]
    assert contract_order(home.load("daily_bars"), "trade_date") == ["trade_date", "symbol"]


def test_older_files_lack_columns(home):
    old = home.spark.createDataFrame([("688001.SH", date(2023, 1, 3), 1.0)], "symbol string, trade_date date, close double")
    lake.write_partitions(old, home.path("daily_bars"), "trade_date", "day")
    got = home.load("daily_bars", end="2023-12-31").collect()
    assert len(got) == 1 and got[0]["volume"] is None and got[0]["close"] == 1.0


def test_quarantine(spark):
    raw = spark.createDataFrame([("a", "2024-06-27", "1", "2", "1", "1.5", "7", "1"), ("a", "soon", "1", "2", "1", "1.5", "7", "1"), (" ", "2024-06-27", "1", "2", "1", "1.5", "x", "1"), ("b", "2024-06-27", "1", "0.5", "1", "NaN", "7", "1")], "symbol string, trade_date string, open string, high string, low string, close string, volume string, amount string")
    good, bad = quarantine(raw, dataset("daily_bars"))
    assert good.count() == 1 and dict(good.dtypes)["volume"] == "bigint"
    assert sorted(tuple(r["bad"]) for r in bad.collect()) == [("cast:trade_date", "missing:trade_date"), ("cast:volume", "blank:symbol"), ("finite:close", "bar")]
