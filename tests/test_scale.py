"""Hot keys, stored tables and streams within bounds: each against the plain form or brute force."""

import random
from datetime import date, datetime, timedelta
from statistics import median

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.operators import adjust, bars, contains, digest, paging, ranks, slices
from marketlake.sources import deltas, lake
from marketlake.sources.atomic import AtomicPartitions, CommitConflict
from marketlake.sources.stats import Statistics
from marketlake.streaming import bars as streams

RND = random.Random(5)
START = datetime(2024, 1, 2, 9, 30)


def key_of(row):
    return tuple((v is not None, str(v)) for v in row)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key_of) == sorted(map(tuple, b.collect()), key=key_of)


@pytest.fixture(scope="module")
def ticks(spark):
    """One symbol holds most rows; gaps of hours, ties of time, null keys and times."""
    rows = [("hot" if RND.random() < 0.8 else RND.choice(["a", "b"]), START + timedelta(minutes=RND.choice([RND.randrange(300), 2000 + RND.randrange(50), RND.randrange(9000)])), i, float(RND.randrange(50))) for i in range(3000)]
    rows += [(None, START, 5000, 1.0), ("hot", None, 5001, 2.0), ("lone", START, 5002, 3.0), (None, None, 5003, None)]
    return spark.createDataFrame(rows, "symbol string, at timestamp, id long, price double").repartition(5).cache()


def test_sliced_asof_equals_the_plain_window(spark, ticks):
    events = ticks.where("id % 7 = 0 AND id < 5000").groupBy("symbol", F.col("at").alias("since")).agg(F.max("price").alias("value"))
    events = events.unionByName(spark.createDataFrame([("a", START, None), (None, START, 9.0), ("hot", None, 9.0)], events.schema))
    left = ticks.where("id < 5000").select("symbol", "at", "id")
    w = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.select("*", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value")).unionByName(events.where("since IS NOT NULL AND symbol IS NOT NULL").select("symbol", F.col("since").alias("at"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("kind"), "value"))
    plain = both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("kind = 1").select("symbol", "at", "id", "value")
    for by in (slices.hours, lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp_ltz")) / 60_000_000)):
        same(slices.asof(left, events, "symbol", "at", "since", "value", by), plain)
    nothing = slices.asof(ticks.where("id >= 5000").select("symbol", "at", "id"), events, "symbol", "at", "since", "value", slices.hours, -1.0)
    assert {r["id"]: r["value"] for r in nothing.collect()} == {5000: -1.0, 5001: -1.0, 5002: -1.0, 5003: -1.0}
    assert slices.asof(left.where("false"), events, "symbol", "at", "since", "value", slices.hours).isEmpty()
    assert slices.asof(left, events.where("false"), "symbol", "at", "since", "value", slices.hours).where("value IS NOT NULL").isEmpty()


def test_sliced_previous_and_running_sum_equal_the_plain_window(ticks):
    whole = ticks.where("symbol IS NOT NULL AND at IS NOT NULL")
    w = Window.partitionBy("symbol").orderBy("at", "id")
    plain = whole.select("*", F.lag("price").over(w).alias("before"), F.lag("at").over(w).alias("before_at"))
    got = slices.previous(ticks, ["symbol"], "at", slices.hours, {"before": "price", "before_at": "at"}, ("id",))
    same(got.where("symbol IS NOT NULL AND at IS NOT NULL"), plain)
    assert got.where("id IN (5000, 5001, 5003)").where("before IS NULL").count() == 3
    same(slices.running_sum(whole, ["symbol"], "at", slices.hours, "id", "total", ("id",)), whole.select("*", F.sum("id").over(w).alias("total")))


def test_one_symbol_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = spark.range(20_000).select(F.lit("hot").alias("symbol"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("at"), "id")
        got = slices.previous(rows, ["symbol"], "at", slices.hours, {"before": "id"}, ("id",))
        assert got.where("before = id - 1").count() == 19_999
        assert got.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 1000").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def bar_rows(spark, n=2000, symbols=40):
    rows = [(f"{600000 + i % symbols}.SH", date(2023, 1, 1) + timedelta(days=i // symbols * 7), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 100 + i, 10.0 * i) for i in range(n)]
    stamp = [F.lit("x").alias("source"), F.lit("v1").alias("data_version"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at")]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume long, amount double").select("*", *stamp)


def test_clustered_layout_reads_few_rows(spark, tmp_path):
    b, root = bar_rows(spark, 20_000, 200), str(tmp_path / "bars")
    lake.write_clustered(b, root, "trade_date", "year", page_rows=100)
    same(lake.scan(spark, root, "trade_date").select(b.columns), b)
    wanted = lake.scan(spark, root, "trade_date", "2024-01-01", "2024-12-31", ["600007.SH"])
    got, read = lake.measured(spark, wanted.collect)
    label, whole = lake.measured(spark, lake.scan(spark, root, "trade_date", "2024-01-01", "2024-12-31").collect)
    assert len(got) == b.where("symbol = '600007.SH' AND year(trade_date) = 2024").count() > 0
    assert whole["rows"] == len(label) and 0 < read["rows"] * 10 < whole["rows"]


def test_digest_adds_up_and_sees_every_change(spark):
    b = bar_rows(spark, 300)
    whole = digest.of_frame(b)
    part, rest = b.where("volume % 3 = 0"), b.where("volume % 3 <> 0")
    assert digest.of_frame(part) + digest.of_frame(rest) == whole and whole - digest.of_frame(part) == digest.of_frame(rest)
    assert digest.of_frame(b.repartition(7)) == whole == digest.of_frame(b.withColumn("fetched_at", F.current_timestamp()))
    for changed in (b.withColumn("close", F.when(F.col("volume") == 150, None).otherwise(F.col("close"))), b.withColumn("open", F.col("high")).withColumn("high", F.col("open")), b.union(b.limit(1))):
        assert digest.of_frame(changed) != whole
    two = [spark.createDataFrame([x], "a string, b string") for x in (("1:x", None), ("1", "x"), (None, "1:x"), ("-", None), (None, None), ("", None))]
    assert len({digest.of_frame(t) for t in two}) == len(two)
    assert digest.of_frame(b.where("false")) == digest.Digest()


def test_statistics_read_changed_files_only(spark, tmp_path):
    b, root = bar_rows(spark, 6000), str(tmp_path / "bars")
    lake.write_partitions(b, root, "trade_date", "year")
    stats = Statistics(spark, root, "trade_date")
    assert stats.refresh() > 1 and stats.refresh() == 0
    lake.write_partitions(b.where("year(trade_date) = 2023").withColumn("source", F.when(F.col("volume") < 200, "y").otherwise("x")), root, "trade_date", "year")
    n, read = lake.measured(spark, stats.refresh)
    in_label = b.where("year(trade_date) = 2023").count()
    assert 0 < n and in_label <= read["rows"] < in_label + 200
    kept = {"p": stats.partitions(), "v": stats.provenance()}
    kept = {k: sorted(map(str, df.collect())) for k, df in kept.items()}
    total = stats.digest()
    assert total == digest.of_frame(lake.scan(spark, root, "trade_date"))
    assert stats.digest(["2023"]) == digest.of_frame(lake.scan(spark, root, "trade_date", "2023-01-01", "2023-12-31"))
    stats.rebuild()
    assert kept == {"p": sorted(map(str, stats.partitions().collect())), "v": sorted(map(str, stats.provenance().collect()))}
    assert {r["label"]: r["n_rows"] for r in stats.partitions().collect()} == {r["label"]: r["n_rows"] for r in lake.partition_stats(spark, root, "trade_date").collect()}
    # Files that are gone leave.
    lake.delete(spark, f"{root}/p_trade_date=2023")
    assert stats.refresh() == 0 and stats.partitions().where("label = '2023'").isEmpty()


def test_compact_reads_the_touched_label_once(spark, tmp_path):
    b, root, key = bar_rows(spark), str(tmp_path / "bars"), ["symbol", "trade_date"]
    lake.write_partitions(b, root, "trade_date", "year")
    staged = b.where("year(trade_date) = 2023 AND volume < 120").withColumn("fetched_at", F.lit("2025-01-01").cast("timestamp"))
    staged.write.parquet(str(tmp_path / "staged"))
    staged = spark.read.parquet(str(tmp_path / "staged"))
    in_label = b.where("year(trade_date) = 2023").count()
    changed, read = lake.measured(spark, lambda: lake.compact(spark, staged, root, key, "trade_date", "year"))
    assert not changed and read["rows"] <= in_label + 2 * staged.count()
    assert lake.compact(spark, staged.withColumn("close", F.lit(7.0)), root, key, "trade_date", "year")
    assert lake.scan(spark, root, "trade_date").where("close = 7.0").count() == staged.count()
    assert lake.scan(spark, root, "trade_date").count() == b.count()


def test_deltas_chain(spark, tmp_path):
    key = ["symbol", "trade_date"]
    one = bar_rows(spark, 400)
    two = one.where("volume <> 130").withColumn("close", F.when(F.col("volume") % 50 == 0, None).otherwise(F.col("close")))
    three = two.where("volume > 150").union(one.where("volume = 130").withColumn("symbol", F.lit("new")))
    at = [str(tmp_path / x) for x in "abc"]
    deltas.make_delta(one, two, key, at[0])
    deltas.make_delta(two, three, key, at[1])
    deltas.make_delta(three, three.withColumn("source", F.lit("other")), key, at[2])
    changes = spark.read.parquet(f"{at[0]}/changes").groupBy("_change").count()
    assert {r["_change"]: r["count"] for r in changes.collect()} == {"delete": 1, "replace": 8} and spark.read.parquet(f"{at[2]}/changes").isEmpty()
    same(deltas.apply_deltas(one, at[:2], key, str(tmp_path / "out")), three)
    same(deltas.apply_deltas(one, at[:1], key, str(tmp_path / "mid")), two)
    same(deltas.apply_deltas(three, at[2:], key, str(tmp_path / "none")), three)
    with pytest.raises(deltas.DeltaError, match="start from"):
        deltas.apply_deltas(two, at[:1], key, str(tmp_path / "wrong"))
    assert not lake.exists(spark, str(tmp_path / "wrong"))
    with pytest.raises(deltas.DeltaError, match="before it ends"):
        deltas.apply_deltas(one, [at[1], at[0]], key, str(tmp_path / "order"))
    with pytest.raises(deltas.DeltaError, match="no finished package"):
        deltas.apply_deltas(one, [str(tmp_path / "absent")], key, str(tmp_path / "x"))


def test_generations_are_claimed(spark, tmp_path):
    a, b = (lake.Generations(spark, str(tmp_path / "t")) for _ in range(2))
    rows = spark.range(3)
    assert a._claimed() == 1 and b.commit(rows) == 2 and a.commit(rows) == 3
    assert a.current() == 3 and b.read(2).count() == 3


TICKS = "symbol string, trade_date date, tick_seq int, trade_time timestamp, price double, volume long"


def tick(symbol, day, seq, minute, price=1.0, volume=1):
    at = datetime(2024, 1, day, 9, 25) + timedelta(minutes=minute)
    return (symbol, at.date(), seq, at, price, volume)


def test_number_ranges():
    seen: set[int] = set()
    bounds: list[int] = []
    for _ in range(60):
        numbers = [RND.randrange(80) for _ in range(RND.randrange(1, 6))]
        bounds, repeated = streams.with_numbers(bounds, np.array(numbers))
        assert repeated == len(numbers) - len(set(numbers) - seen)
        seen |= set(numbers)
        assert {x for a, b in zip(bounds[::2], bounds[1::2]) for x in range(a, b + 1)} == seen
        assert all(b + 1 < a for b, a in zip(bounds[1::2], bounds[2::2]))


def test_day_findings_drop_their_state(spark, tmp_path):
    src = str(tmp_path / "ticks")
    first = [tick("a", 5, i, i) for i in (0, 1, 2, 5, 5)] + [tick("b", 5, 3, 6)]
    second = [tick("a", 5, 3, 7), tick("a", 8, 0, 0)]
    last = [tick("z", 20, 0, 0)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        held = []
        for rows in (first, second, last):
            spark.createDataFrame([*rows, (None, date(2024, 1, 5), 1, rows[0][3], 1.0, 1)], TICKS).coalesce(1).write.mode("append").parquet(src)
            found = streams.session_findings(spark.readStream.schema(TICKS).parquet(src), "0 seconds")
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
            held.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
        got = sorted((r["symbol"], r["trade_date"].day, r["n"], r["n_off"], r["n_repeated"], r["lo"], r["hi"], r["n_missing"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [("a", 5, 6, 2, 1, 0, 5, 1), ("a", 8, 1, 0, 0, 0, 0, 0), ("b", 5, 1, 0, 0, 3, 3, 0)]
        assert max(held[0]) >= 2 and held[-1][-1] <= held[0][0]  # the last day's state is all that is left
    finally:
        spark.conf.unset(provider)


def test_late_ticks_change_exactly_their_bars(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [
        [tick("a", 5, i, i, float(i)) for i in range(30)] + [tick("b", 5, 0, 3), tick("a", 8, 0, 600, 5.0)],
        [tick("a", 5, 40, 7, 99.0)],  # days behind the newest tick
        [tick("a", 5, 40, 7, 50.0), tick("c", 9, 0, 0)],  # the same tick again with another price, and a new day
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(src)
        before = {tuple(r) for r in spark.read.parquet(f"{out}/bars").collect()} if i else set()
        streams.correcting_bars(spark.readStream.schema(TICKS).parquet(src), out, str(tmp_path / "ck"), 5).awaitTermination()
        after = {tuple(r) for r in spark.read.parquet(f"{out}/bars").collect()}
        if i == 1:
            changed = {r[:2] for r in before ^ after}
            assert len(changed) == 1 and len(after) == len(before)
        if i == 2:
            assert len(after) == len(before) + 1 and len(before - after) == 1
    log = spark.read.parquet(f"{out}/revisions").groupBy("batch", "replaced").count().collect()
    assert {(r["batch"], r["replaced"]): r["count"] for r in log} == {(0, False): 8, (1, True): 1, (2, True): 1, (2, False): 1}
    got = {(r["symbol"], r["bar_start"]): (r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in spark.read.parquet(f"{out}/bars").collect()}
    assert got["a", datetime(2024, 1, 5, 9, 30)] == (5.0, 50.0, 5.0, 9.0, 6)
    # A replayed batch changes nothing.
    again = spark.createDataFrame(steps[2], TICKS)
    streams.revise_bars(again, 2, out, 5)
    assert {(r["symbol"], r["bar_start"]): (r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in spark.read.parquet(f"{out}/bars").collect()} == got
    assert spark.read.parquet(f"{out}/revisions").count() == 11 and spark.read.parquet(f"{out}/ticks").count() == 35


def test_substring_pairs(spark):
    texts = lambda n: [RND.choice(["", "银行", None]) if RND.random() < 0.05 else "".join(RND.choices("ab银行 ", k=RND.randrange(0, 7))) for _ in range(n)]
    left, right = texts(150), texts(150)
    got = contains.overlapping(*(spark.createDataFrame([(t,) for t in ts], f"{name} string") for name, ts in (("left", left), ("right", right))))
    want = {(a, b) for a in left if a for b in right if b and (a in b or b in a)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("grid", "accuracy", "few"), [(ranks.GRID, ranks.ACCURACY, ranks.FEW), (4, 40, 3)])
def test_grouped_median_is_exact(spark, monkeypatch, grid, accuracy, few):
    for name, v in (("GRID", grid), ("ACCURACY", accuracy), ("FEW", few)):
        monkeypatch.setattr(ranks, name, v)
    groups = {
        "hot": [RND.lognormvariate(0, 9) for _ in range(4001)], "even": [RND.random() for _ in range(2000)], "ties": [1.0] * 900 + [2.0] * 901, "near": [1.0] * 1000 + [RND.random() + 1 for _ in range(1003)],
        "one": [5.0], "two": [1.0, 4.0], "same": [7.0] * 50, None: [3.0, 1.0, 2.0], "gone": [], "wide": [-1e300, 1e-300, 1e300, 0.0, 5.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    got = ranks.grouped_median(spark.createDataFrame(rows, "g string, v double").repartition(6), "g", "v", lake.kept)
    assert {r["g"]: (r["n"], r["median"]) for r in got.collect()} == {g: (len(vs), pytest.approx(median(vs), rel=1e-15)) for g, vs in groups.items() if vs}


def test_qfq_function_in_sql(spark):
    b = bar_rows(spark, 200, 5)
    f = b.where("volume % 3 <> 0").select("symbol", "trade_date", F.lit("hfq").alias("adjust_type"), (F.col("volume") / 50).alias("factor"))
    lake.register_views({"q_bars": b, "q_factors": f})
    adjust.register_qfq_function(spark, "q_bars", "q_factors", "q_qfq")
    kept = ("symbol", "trade_date", "adj_close", "adj_is_exact")
    for call, bounds in (("q_qfq(DATE '2023-02-01', DATE '2023-06-30')", ("2023-02-01", "2023-06-30")), ("q_qfq(NULL, DATE '2023-06-30')", (None, "2023-06-30")), ("q_qfq()", (None, None)), ("q_qfq(start_date => DATE '2023-03-01')", ("2023-03-01", None))):
        same(spark.sql(f"SELECT {', '.join(kept)} FROM {call}"), adjust.qfq_window(b, f, *bounds).select(*kept))


def test_pages_and_totals_come_from_one_run(spark, tmp_path):
    bar_rows(spark).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "b"))
    page, read = lake.measured(spark, lambda: paging.page_with_total(df.where("volume > 500"), 10, 20, ["trade_date", "symbol"]))
    assert (page.total, page.truncated, read["rows"]) == (1599, True, 2000)
    assert page.rows.collect() == df.where("volume > 500").orderBy("trade_date", "symbol").offset(20).limit(10).collect()
    df.createOrReplaceTempView("paged")
    (rows, total), read = lake.measured(spark, lambda: lake.run_sql(spark, "SELECT * FROM paged", 7))
    assert (rows.count(), total, read["rows"]) == (7, 2000, 2000)
    assert lake.run_sql(spark, "SELECT * FROM paged WHERE false", 7)[1] == 0
    keys = ["trade_date", "symbol"]
    seen, cursor = [], None
    while got := [tuple(r) for r in paging.keyset_page(df.select(*keys), keys, cursor, 300).collect()]:
        seen += got[:300]
        if len(got) <= 300:
            break
        cursor = got[299]
    assert seen == sorted(tuple(r) for r in df.select(*keys).collect())


def test_sliced_returns_equal_plain_ones(spark):
    b = bar_rows(spark, 1200, 6).withColumn("factor", 1 + F.col("volume") / 1000)
    same(bars.raw_and_adjusted_returns(b, slices.years), bars.raw_and_adjusted_returns(b))
    days = b.select("trade_date").distinct()
    sessions = days.select("trade_date", F.lag("trade_date").over(Window.orderBy("trade_date")).alias("prev_date"))
    for df in (b, b.where("volume % 5 <> 0")):
        same(bars.session_returns(df, sessions, by=slices.years), bars.session_returns(df, sessions).select(bars.session_returns(df, sessions, by=slices.years).columns))


def test_labels_are_replaced_at_once(spark, tmp_path):
    b = bar_rows(spark, 3000, 20)
    t = AtomicPartitions(spark, str(tmp_path / "t"), "trade_date", "quarter")
    assert t.replace(b) == 1 and t.current() == 1
    old = t.read()
    late = AtomicPartitions(spark, str(tmp_path / "t"), "trade_date", "quarter")
    changed = b.where("quarter(trade_date) = 2 AND year(trade_date) = 2023").withColumn("close", F.lit(0.5))
    assert t.replace(changed) == 2
    same(old.select(b.columns), b)
    assert t.read("2023-04-01", "2023-06-30").where("close = 0.5").count() == changed.count() == t.read().where("close = 0.5").count()
    assert t.read().count() == b.count() and t.read("2023-05-02", "2023-05-20", ["600003.SH"]).count() == b.where("trade_date BETWEEN '2023-05-02' AND '2023-05-20' AND symbol = '600003.SH'").count()
    assert t.read("2050-01-01").isEmpty() and t.read("2050-01-01").columns == t.read().columns
    with pytest.raises(CommitConflict):
        late.replace(changed, base=1)
    # A writer that died holds its number until it is released.
    _, p = lake._fs(spark, str(tmp_path / "t" / "claims" / "3"))
    lake._fs(spark, str(tmp_path / "t"))[0].createNewFile(p)
    with pytest.raises(CommitConflict):
        t.replace(changed)
    t.release(3)
    assert t.replace(b.where("false"), drop=("2023Q1",)) == 3
    assert t.read().where("trade_date < '2023-04-01'").isEmpty() and t.vacuum() == [1, 2]
    assert t.read().count() == b.where("trade_date >= '2023-04-01'").count()
    with pytest.raises(ValueError):
        t.read(commit=1)


def test_incremental_stats_rewrites_a_label_from_its_stored_rows(spark, monkeypatch):
    """The label that changes is read from the lake; the bars are not derived a second time for it."""
    from __spark_entry__ import queries
    from marketlake.sources import lake

    read, real = [], lake.write_partitions
    monkeypatch.setattr(lake, "write_partitions", lambda df, *a: read.append(df.inputFiles()) or real(df, *a))
    rows = queries()["m4_incremental_stats"](spark, "/root/testdata/sf0.001").collect()
    assert len(read) == 2 and read[1] and not [f for f in read[1] if "lineitem" in f]
    assert {r["label"] for r in rows if r["data_version"] == "v2"} == {"1998"} and all(r["only_changed"] for r in rows)
