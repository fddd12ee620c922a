"""Exact small cases of the core operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketlake.functions import market, symbols, text
from marketlake.operators import adjust, asof, bars, canonical, pit, universe
from marketlake.plans import derive, quality

D = date(2024, 6, 27)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    b = [("600519.SH", D, 10.0, 11.0, 9.0, 10.5, 100, 1050.0), ("000001.SZ", D, 20.0, 21.0, 19.0, 20.5, 100, 2050.0), ("300750.SZ", D, 30.0, 31.0, 29.0, 30.5, 100, 3050.0)]
    return {
        "bars": spark.createDataFrame(b, "symbol string, trade_date date, open double, high double, low double, close double, volume long, amount double"),
        "factors": spark.createDataFrame([("600519.SH", D, "hfq", 2.0), ("000001.SZ", D, "hfq", 3.0)], "symbol string, trade_date date, adjust_type string, factor double"),
        "instruments": spark.createDataFrame([(x[0], x[0], date(2010, 1, 1), None) for x in b], "symbol string, name string, list_date date, delist_date date"),
        "status": spark.createDataFrame([("600519.SH", D, True, "normal", False), ("000001.SZ", D, True, "st", None), ("300750.SZ", D, False, "suspended", None)], "symbol string, trade_date date, is_trading boolean, status string, risk_warning boolean"),
    }


def test_hfq(small):
    got = {r["symbol"]: (r["adj_close"], r["adj_is_exact"], r["factor"]) for r in adjust.hfq(small["bars"], small["factors"]).collect()}
    assert got == {"600519.SH": (21.0, True, 2.0), "000001.SZ": (61.5, True, 3.0), "300750.SZ": (30.5, False, 1.0)}
    with pytest.raises(adjust.MissingFactors):
        adjust.hfq(small["bars"], small["factors"], strict=True)


def test_universe(small):
    kept = universe.apply_universe(small["bars"], small["instruments"], small["status"])
    assert rows(kept.select("symbol")) == [("600519.SH",)]
    with pytest.raises(universe.UniverseCoverageError):
        universe.apply_universe(small["bars"], small["instruments"], small["status"].where("false"), strict=True)


def test_qfq_anchors(spark):
    days = [date(2024, 1, i) for i in (1, 2, 3)]
    b = spark.createDataFrame([("600519.SH", d, c) for d, c in zip(days, (10.0, 12.0, 14.0))], "symbol string, trade_date date, close double")
    f = spark.createDataFrame([("600519.SH", d, "hfq", x) for d, x in zip(days, (2.0, 3.0, 4.0))], "symbol string, trade_date date, adjust_type string, factor double")
    assert [r["adj_close"] for r in adjust.qfq_whole_lake(b, f).orderBy("trade_date").collect()] == [5.0, 9.0, 14.0]
    assert [r["adj_close"] for r in adjust.qfq_window(b, f, end="2024-01-02").orderBy("trade_date").collect()] == pytest.approx([20 / 3, 12.0])
    assert [r["adj_close"] for r in adjust.qfq_base_date(b, f, "2024-01-02").orderBy("trade_date").collect()] == pytest.approx([20 / 3, 12.0, 56 / 3])


def test_canonical_tie(spark):
    t = datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", 1.0, "backup", "v1", t), ("a", 2.0, "primary", "v1", t), ("b", 3.0, "primary", "v1", None), ("b", 4.0, "backup", "v1", t)], "symbol string, x double, source string, data_version string, fetched_at timestamp")
    assert rows(canonical.canonical(df, ["symbol"], "primary", "backup").select("symbol", "x"), "symbol") == [("a", 2.0), ("b", 4.0)]


def test_pit_vintages(spark):
    df = spark.createDataFrame(
        [("s", "2023Q4", "i", "x", date(2024, 4, 20), 100.0, "v", datetime(2024, 4, 20)), ("s", "2023Q4", "i", "x", date(2025, 3, 15), 90.0, "v", datetime(2025, 3, 15)), ("s", "2023Q3", "i", "x", date(2024, 1, 1), 1.0, "a_backfill", datetime(2024, 1, 1))],
        "symbol string, report_period string, statement_type string, item_code string, announce_date date, item_value double, source string, fetched_at timestamp",
    )
    key = ["symbol", "report_period", "statement_type", "item_code", "announce_date"]
    value = lambda day, **kw: sorted(r["item_value"] for r in pit.read_pit(df, key, day, **kw).collect())
    assert value("2024-06-30") == [1.0, 100.0]
    assert value("2025-06-30") == [1.0, 90.0]
    assert value("2025-06-30", all_vintages=True) == [1.0, 90.0, 100.0]
    assert value("2025-06-30", mode="strict") == [90.0]
    assert [r["pit_is_exact"] for r in pit.classify(df, "2025-06-30").where("source = 'a_backfill'").collect()] == [False]


def test_asof(spark):
    events = spark.createDataFrame([("a", date(2024, 1, 5), 2.0), ("a", date(2024, 1, 10), 3.0)], "symbol string, ex_date date, factor double")
    days = spark.createDataFrame([("a", date(2024, 1, d)) for d in (4, 5, 9, 10, 20)] + [("b", date(2024, 1, 4))], "symbol string, trade_date date")
    got = asof.asof_step(days, events, "symbol", "trade_date", "ex_date", "factor", 1.0).orderBy("symbol", "trade_date")
    assert [r["factor"] for r in got.collect()] == [1.0, 2.0, 2.0, 3.0, 3.0, 1.0]


def test_membership_as_of(spark):
    m = spark.createDataFrame([("600000.SH", "240301", date(2026, 5, 1)), ("600000.SH", "270101", date(2026, 6, 1))], "symbol string, industry_code string, start_date date")
    d = spark.createDataFrame([(date(2026, 5, 15),), (date(2026, 6, 15),)], "as_of_date date")
    got = asof.expand_open(m, d, "symbol", "start_date", "as_of_date").orderBy("as_of_date")
    assert [r["industry_code"] for r in got.collect()] == ["240301", "270101"]


def test_suspension(spark):
    days = [date(2024, 6, d) for d in (26, 27, 28)]
    b = [("000001.SZ", d, 1) for d in days if d.day != 27] + [("600519.SH", d, 1) for d in days] + [("510300.SH", days[0], 1), ("510300.SH", days[2], 1)] + [("300001.SZ", d, 0) for d in days]
    bars_ = spark.createDataFrame(b, "symbol string, trade_date date, volume long")
    sessions = spark.createDataFrame([(d,) for d in days], "trade_date date")
    inst = spark.createDataFrame([(s, date(2010, 1, 1), None) for s in {x[0] for x in b}], "symbol string, list_date date, delist_date date")
    assert rows(derive.suspension_history(bars_, sessions, inst).select("symbol", "trade_date")) == [("000001.SZ", date(2024, 6, 27))]


def test_industry_index_no_bridging(spark):
    days = [date(2024, 6, d) for d in (26, 27, 28)]
    data = [("a.SH", days[0], 10.0), ("a.SH", days[1], 11.0), ("b.SH", days[0], 10.0), ("b.SH", days[1], 10.0), ("c.SH", days[0], 10.0), ("c.SH", days[2], 20.0)]
    b = spark.createDataFrame([(s, d, c, 1, 1e8) for s, d, c in data], "symbol string, trade_date date, close double, volume long, amount double")
    f = b.select("symbol", "trade_date", F.lit("hfq").alias("adjust_type"), F.lit(1.0).alias("factor"))
    m = spark.createDataFrame([(s, "240301", date(2024, 1, 1), "sw") for s in ("a.SH", "b.SH")], "symbol string, industry_code string, as_of_date date, source string")
    s = asof.with_neighbours(spark.createDataFrame([(d,) for d in days], "trade_date date"))
    got = {(r["weighting"]): (round(r["ret"], 9), r["n_members"], r["n_priced"], r["n_excluded"]) for r in derive.industry_index(m, b, f, s, ("L3",)).collect()}
    assert got == {"equal": (0.05, 2, 2, 0), "amount": (0.05, 2, 2, 0)}
    assert bars.session_returns(b.where("symbol = 'c.SH'"), s).count() == 0


def test_event_types(spark):
    titles = ["收到行政处罚", "处罚决定书", "立案告知", "监管函", "警示函", "纪律处分", "年度报告"]
    df = spark.createDataFrame([(str(i), "600519.SH", t, D) for i, t in enumerate(titles)], "announcement_id string, symbol string, title string, announce_date date")
    got = {r["event_id"]: r["event_type"] for r in derive.regulatory_events(df).collect()}
    assert got == {"reg-0": "penalty", "reg-1": "penalty", "reg-2": "investigation", "reg-3": "regulatory_letter", "reg-4": "warning_letter", "reg-5": "disciplinary"}


def test_ticks_sequence(spark):
    make = lambda seqs: spark.createDataFrame([("a", D, s) for s in seqs], "symbol string, trade_date date, tick_seq int")
    assert quality.tick_sequence_gaps(make(range(10))).count() == 0
    for bad in ([0, 1, 3], [0, 1, 1, 2], [1, 2, 3]):
        assert quality.tick_sequence_gaps(make(bad)).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([("689009.SH", "公司盈利增长，风险"), ("830001.SZ", None), ("430001.BJ", "")], "symbol string, t string")
    s = F.col("symbol")
    got = df.select(symbols.in_universe(s), symbols.is_cdr(symbols.code(s), symbols.exchange(s)), F.round(text.keyword_sentiment(F.col("t")), 6)).collect()
    assert [tuple(r) for r in got] == [(False, True, round((2.2 - 0.7) / 2.9, 6)), (False, False, 0.0), (True, False, 0.0)]
    one = spark.range(1)
    d = F.lit("2024-05-09").cast("date")
    assert tuple(one.select(market.quarter_label(d), market.week_start(d), market.partition_value(d, "month"), market.relative_bps(F.lit(0.0), F.lit(0.0))).first()) == ("2024Q2", date(2024, 5, 6), "2024-05", 0.0)


def test_empty_inputs(small):
    b = small["bars"].where("false")
    assert adjust.daily_bars_adj(b, small["factors"]).count() == 0
    assert bars.period_bars(b, "week").count() == 0
    assert derive.delisting_events(b).count() == 0
    assert quality.volume_unit(b.withColumn("source", F.lit("x"))).count() == 0
