"""Write path, generations and streaming on small tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from marketlake import registry
from marketlake.sources import lake
from marketlake.streaming import bars as stream

SCHEMA = "symbol string, trade_date date, close double, source string, data_version string, fetched_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(s, d, c, "x", "v1", datetime(2024, 1, h)) for s, d, c, h in rows], SCHEMA)


def test_compact_and_scan(spark, tmp_path):
    root, key = str(tmp_path / "bars"), ["symbol", "trade_date"]
    first = frame(spark, [("a", date(2024, 1, 5), 1.0, 1), ("a", date(2024, 2, 5), 2.0, 1)])
    assert lake.compact(spark, first, root, key, "trade_date", "month")
    assert not lake.compact(spark, first, root, key, "trade_date", "month")
    newer = frame(spark, [("a", date(2024, 2, 5), 3.0, 2), ("b", date(2024, 2, 6), 4.0, 2)])
    assert lake.compact(spark, newer, root, key, "trade_date", "month")
    got = lake.scan(spark, root, "trade_date", "2024-02-01", "2024-02-28").orderBy("symbol")
    assert [(r["symbol"], r["close"]) for r in got.collect()] == [("a", 3.0), ("b", 4.0)]
    assert "p_trade_date" not in got.columns
    assert lake.scan(spark, root, "trade_date", "2030-01-01").count() == 0
    assert {r["label"]: r["n_rows"] for r in lake.partition_stats(spark, root, "trade_date").collect()} == {"2024-01": 1, "2024-02": 2}
    assert lake.repartition_dataset(spark, root, str(tmp_path / "yearly"), "trade_date", "year") == 3


def test_generations(spark, tmp_path):
    g = lake.Generations(spark, str(tmp_path / "t"))
    assert g.current() is None
    a = frame(spark, [("a", date(2024, 1, 5), 1.0, 1)])
    b = frame(spark, [("a", date(2024, 1, 5), 2.0, 1), ("b", date(2024, 1, 5), 1.0, 1)])
    assert (g.commit(a), g.commit(b)) == (1, 2)
    assert (g.read(1).count(), g.read().count()) == (1, 2)
    changes = lake.delta(g.read(1), g.read(2), ["symbol", "trade_date"])
    assert sorted((r["symbol"], r["change"]) for r in changes.collect()) == [("a", "replace"), ("b", "add")]
    assert g.prune(1) == [1]


def test_registry(spark):
    assert len(registry.DATASETS) == 42
    assert registry.dataset("daily_bars").empty(spark).count() == 0
    c = registry.contracts(spark)
    assert registry.contract_diff(c, c).count() == 0
    assert registry.contract_diff(c, c.where("column <> 'close'")).where("change = 'removed'").count() > 0


def test_contract_compatibility(spark):
    c = registry.contracts(spark).drop("fingerprint")
    assert registry.compatibility(c, c).isEmpty()
    changed = c.where("dataset <> 'hot_rank' AND NOT (dataset = 'daily_bars' AND column = 'amount')")
    changed = changed.withColumn("type", F.when((F.col("dataset") == "adj_factors") & (F.col("column") == "factor"), "float").otherwise(F.col("type")))
    changed = changed.withColumn("pit", F.when(F.col("dataset") == "top_holders", False).otherwise(F.col("pit"))).withColumn("storage", F.when(F.col("dataset") == "fund_flow", "trade_date/year").otherwise(F.col("storage")))
    changed = changed.withColumn("key_position", F.when((F.col("dataset") == "delisting_events") & (F.col("column") == "bars"), 1).otherwise(F.col("key_position")))
    more = spark.createDataFrame([("daily_bars", "vwap", "double", None, False, "trade_date/day"), ("macro_indicators", "region", "string", 2, False, "obs_date/year"), ("new_set", "a", "string", 0, False, "/")], c.schema)
    got = {(r["dataset"], r["column"], r["kind"], r["breaking"]) for r in registry.compatibility(c, changed.unionByName(more)).collect()}
    assert got == {
        ("hot_rank", None, "dataset_removed", True), ("new_set", None, "dataset_added", False), ("daily_bars", "amount", "column_removed", True), ("daily_bars", "vwap", "column_added", False), ("adj_factors", "factor", "column_retyped", True),
        ("top_holders", None, "pit_changed", True), ("fund_flow", None, "storage_changed", True), ("delisting_events", None, "key_changed", True), ("macro_indicators", "region", "column_added", True), ("macro_indicators", None, "key_changed", True),
    }


def test_profile_against_the_contract(spark):
    rows = spark.createDataFrame([("a", None, 1), (None, None, 2)], "symbol string, trade_date date, volume int")
    got = {r["column"]: (r["n_rows"], r["n_null"], r["finding"]) for r in registry.profile(rows, "daily_bars").collect()}
    assert got["symbol"] == (2, 1, "null_key") and got["volume"] == (2, 0, "retyped") and got["close"] == (2, 2, "missing") and len(got) == 11
    assert {r["n_rows"] for r in registry.profile(rows.where("false"), "daily_bars").collect()} == {0}


def test_tick_stream(spark, tmp_path):
    src = str(tmp_path / "ticks")
    rows = [("a", date(2024, 1, 5), i, datetime(2024, 1, 5, 9, 30 + i), float(i), 1) for i in range(20)]
    schema = "symbol string, trade_date date, tick_seq int, trade_time timestamp, price double, volume long"
    spark.createDataFrame(rows + rows[:3], schema).coalesce(1).write.parquet(src)
    ticks = stream.first_ticks(spark.readStream.schema(schema).parquet(src))
    q = ticks.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 20
    q = stream.tick_bars(spark.readStream.schema(schema).parquet(src).where("tick_seq < 20"), 5, "0 seconds").writeStream.format("memory").queryName("tbars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    first = spark.table("tbars").orderBy("bar_start").first()
    assert (first["open"], first["close"], first["high"]) == (0.0, 4.0, 4.0)
    q = stream.session_checks(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("checks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("checks").first()["n"] == 23


def test_stream_upsert(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [("a", date(2024, 1, 5), 1.0, 1), ("a", date(2024, 1, 5), 2.0, 2)]).write.parquet(src)
    q = stream.upsert_stream(spark.readStream.schema(SCHEMA).parquet(src), root, str(tmp_path / "ck"), ["symbol", "trade_date"], "trade_date", "month")
    q.awaitTermination(60)
    assert [r["close"] for r in spark.read.parquet(root).select(F.col("close")).collect()] == [2.0]
