"""Quality checks and reports against small tables worked out by hand from their rules."""

from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlake.plans import quality as Q
from marketlake.plans import reports

MONDAY = date(2024, 6, 3)
DAYS = [MONDAY + timedelta(days=i) for i in range(5)]
BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume long, amount double, source string, fetched_at timestamp"
STATUS = "symbol string, trade_date date, is_trading boolean, status string, risk_warning boolean, source string, fetched_at timestamp"


def bars(spark, rows):
    """Rows of (symbol, day, close, volume, amount, source)."""
    return spark.createDataFrame([(s, d, c, c, c, c, v, a, src, datetime(2024, 7, 1)) for s, d, c, v, a, src in rows], BAR)


def row(symbol, day, close=1.0, volume=100, amount=100.0, source="x"):
    return symbol, DAYS[day] if isinstance(day, int) else day, close, volume, amount, source


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "trade_date date")


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_contract_violations(spark):
    rows = [("a", DAYS[0], 1.0, 2.0, 0.5, 1.5, 10, 5.0, "x", None), (" ", DAYS[0], 1.0, 2.0, 0.5, 3.0, 10, 5.0, "mock", None), (None, None, 1.0, 2.0, 0.5, float("nan"), 10, float("inf"), "x", None)]
    got = {r["rule"]: r["n"] for r in Q.contract_violations(spark.createDataFrame(rows, BAR), ["symbol", "trade_date"]).collect()}
    assert (got["n_rows"], got["blank_symbol"], got["blank_trade_date"], got["not_finite_close"], got["not_finite_amount"], got["mock_rows"]) == (3, 2, 1, 1, 1, 1) and got["invalid_bars"] >= 1


def test_row_mutation(spark):
    rows = [row(f"s{i}", date(2024, m, 1)) for m, n in ((1, 60), (2, 29), (3, 40), (4, 100)) for i in range(n)] + [row("s0", date(2024, 5, 1)) for _ in range(80)]
    got = Q.row_mutation(bars(spark, rows), F.month("trade_date"))
    # February lost over half, March follows a month below the baseline, May has rows but one symbol only.
    assert found(got, "period", "n_rows", "n_symbols") == [(2, 29, 29), (5, 80, 1)]


def test_fragmentation(spark):
    files = [("many", str(i), 10) for i in range(40)] + [("few", "1", 10)] + [("full", str(i), 50) for i in range(40)]
    assert found(Q.fragmentation(spark.createDataFrame(files, "dataset string, partition string, n_rows long")), "dataset", "n_partitions") == [("many", 40)]


def test_calendar_checks(spark, sessions):
    saturday = date(2024, 6, 8)
    b = bars(spark, [row("a", 0), row("a", 1), row("a", 3), row("a", saturday), row("b", 1), row("b", 4)])
    assert found(Q.calendar_mismatch(b, sessions), "trade_date", "problem") == [(DAYS[2], "missing_day"), (saturday, "orphan")]
    assert found(Q.session_coverage(b, sessions), "symbol", "n_missing", "n_orphan") == [("a", 2, 1), ("b", 2, 0)]
    assert found(Q.coverage_gaps(b, sessions), "symbol", "gap_start", "gap_end", "n_missing") == [("a", DAYS[2], DAYS[2], 1), ("a", DAYS[4], DAYS[4], 1), ("b", DAYS[2], DAYS[3], 2)]
    assert found(Q.heatmap(b, sessions), "symbol", "month", "covered", "missed") == [("a", date(2024, 6, 1), 3, 2), ("b", date(2024, 6, 1), 2, 2)]
    calendar = spark.createDataFrame([(d, True) for d in DAYS], "trade_date date, is_trading boolean")
    assert found(Q.calendar_horizon(calendar, "2024-06-05"), "trade_date") == [(DAYS[3],), (DAYS[4],)]


def test_coverage_of_valuations_and_factors(spark):
    b = bars(spark, [row("600001.SH", 0), row("600002.SH", 0), row("600003.SH", 0, volume=0), row("600001.SH", 1), row("000001.SZ", 0)])
    v = spark.createDataFrame([("600001.SH", DAYS[0]), ("600003.SH", DAYS[0]), ("600001.SH", DAYS[1])], "symbol string, trade_date date")
    assert found(Q.valuation_coverage(v, b), "trade_date", "n_bars", "n_valued") == [(DAYS[0], 3, 1)]
    f = spark.createDataFrame([("600001.SH", DAYS[0]), ("600001.SH", DAYS[1]), ("600003.SH", DAYS[0]), ("000001.SZ", DAYS[0])], "symbol string, trade_date date")
    assert [(r["exchange"], r["n_symbols"], r["n_covered"]) for r in Q.factor_coverage(b, f).collect()] == [("SH", 3, 2)]


def test_adjustment_breaks_and_unexplained_steps(spark, sessions):
    rows = [("jump", 10.0, 1.0), ("jump", 10.0, 2.0), ("gap", 10.0, 1.0), ("split", 10.0, 1.0), ("split", 5.0, 2.0), ("told", 10.0, 1.0), ("told", 5.0, 2.0)]
    days = {"jump": (0, 1), "gap": (0,), "split": (0, 1), "told": (0, 1)}
    at = {s: iter(d) for s, d in days.items()}
    b = spark.createDataFrame([(s, DAYS[next(at[s])], c, f) for s, c, f in rows] + [("gap", DAYS[3], 10.0, 2.0)], "symbol string, trade_date date, close double, factor double")
    # The adjusted price doubles where the raw one does not; over a gap of sessions it is no break.
    assert found(Q.adjusted_breaks(b, sessions), "symbol", "trade_date", "n_found") == [("jump", DAYS[1], 1)]
    actions = spark.createDataFrame([("told", DAYS[1]), ("split", DAYS[0])], "symbol string, ex_date date")
    assert found(Q.missing_actions(b, actions), "symbol", "trade_date") == [("split", DAYS[1])]
    steps = spark.createDataFrame([("a", DAYS[i], "hfq", f) for i, f in enumerate((1.0, 25.0, 25.0, 1.0, 1.0))], "symbol string, trade_date date, adjust_type string, factor double")
    assert found(Q.factor_steps(steps), "symbol", "trade_date") == [("a", DAYS[1]), ("a", DAYS[3])]


def test_factor_crosscheck(spark):
    b = spark.createDataFrame([("ok", DAYS[0], 10.0, 1.0), ("ok", DAYS[1], 9.0, 10 / 9), ("off", DAYS[0], 10.0, 1.0), ("off", DAYS[1], 9.0, 1.5), ("none", DAYS[0], 1.0, 1.0), ("none", DAYS[1], 1.0, 1.0)], "symbol string, trade_date date, close double, factor double")
    terms = [("ok", DAYS[1], 1.0), ("off", DAYS[1], 1.0), ("none", DAYS[1], 2.0)]
    actions = spark.createDataFrame([(s, d, cash, 0.0, 0.0, 0.0, None) for s, d, cash in terms], "symbol string, ex_date date, cash_dividend double, bonus_ratio double, transfer_ratio double, allotment_ratio double, allotment_price double")
    assert found(Q.factor_crosscheck(b, actions), "symbol", "degenerate") == [("none", True), ("off", False)]


def test_survivorship(spark):
    last = date(2024, 6, 1)
    b = bars(spark, [row("old", date(2021, 1, 4)), row("quiet", date(2023, 6, 1)), row("recent", date(2024, 3, 1)), row("live", last)])
    inst = spark.createDataFrame([("old", date(2021, 2, 1)), ("quiet", None), ("live", None)], "symbol string, delist_date date")
    assert found(Q.survivorship(b, inst), "symbol", "undated") == [("old", False), ("quiet", True)]
    assert Q.survivorship(b.where("symbol <> 'old'"), inst).isEmpty()  # too short a lake


def test_close_and_sources(spark):
    b = bars(spark, [row("a", 0, 10.0, amount=3.0), row("b", 0, 20.0, amount=2.0), row("c", 0, 30.0, amount=1.0)])
    reference = spark.createDataFrame([("a", DAYS[0], 10.005), ("b", DAYS[0], 20.5), ("c", DAYS[0], 99.0)], "symbol string, trade_date date, close double")
    assert found(Q.close_mismatch(b, reference, n=2), "symbol") == [("b",)]
    primary = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, None), ("c", 1.0, 5.0)], "symbol string, close double, amount double")
    backup = spark.createDataFrame([("a", 1.02, 5.0), ("b", 1.0, 5.0), ("d", 1.0, 5.0)], "symbol string, close double, amount double")
    diff = Q.source_diff(primary, backup, ["symbol"], ["close", "amount"], 50)
    assert found(diff, "symbol", "field", "state") == [("a", "close", "drift"), ("b", "amount", "null_mismatch"), ("c", "*", "only_primary"), ("d", "*", "only_backup")]
    assert found(Q.diff_gate(diff, 4, 0.2), "field", "state", "n") == [("*", "only_backup", 1), ("*", "only_primary", 1), ("amount", "null_mismatch", 1), ("close", "drift", 1)]
    assert Q.diff_gate(diff, 4, 0.25).isEmpty()
    official = spark.createDataFrame([("a", DAYS[0], 10.0), ("b", DAYS[0], 21.0)], "symbol string, trade_date date, close double")
    assert [(r["symbol"], round(r["worst_bps"])) for r in Q.publisher_drift(b, official, ["close"], 10).collect()] == [("b", 476)]


def test_units_and_amounts(spark):
    rows = [row("a", 0, 2.0, 100, 200.0, "shares")] * 250 + [row("a", 0, 2.0, 1, 200.0, "lots")] * 250 + [row("a", 0, 2.0, 1, 200.0, "few")] * 10 + [row("a", 0, 2.0, 0, 200.0, "still")] * 300
    assert [(r["source"], r["median_ratio"], r["n_rows"]) for r in Q.volume_unit(bars(spark, rows)).collect()] == [("lots", 100.0, 250)]
    rows = [row("a", 0, amount=None if i < 5 else 1.0, source="some") for i in range(20)] + [row("a", 0, source="all")] * 20 + [row("a", 0, amount=None, source="few")] * 5
    assert found(Q.amount_completeness(bars(spark, rows)), "source", "null_share") == [("some", 0.25)]


def test_labels(spark):
    rows = [("a", DAYS[0], True, "normal", True, "x", datetime(2024, 6, 3)), ("a", DAYS[1], True, "normal", False, "x", datetime(2024, 6, 4)), ("b", DAYS[0], True, "normal", True, "x", datetime(2024, 6, 3)), ("c", DAYS[0], True, "normal", None, "x", datetime(2024, 6, 3))]
    inst = spark.createDataFrame([("a", "ST alpha"), ("b", "*ST beta"), ("c", "gamma ST"), ("d", "ST delta")], "symbol string, name string")
    assert found(Q.st_labels(spark.createDataFrame(rows, STATUS), inst), "symbol", "labelled", "named") == [("a", False, True), ("d", False, True)]


def test_intraday(spark):
    at = lambda h, m, day=DAYS[0]: datetime(day.year, day.month, day.day, h, m)
    rows = [("a", DAYS[0], at(9, 31), 10, 10.0), ("a", DAYS[0], at(12, 0), 10, 10.0), ("b", DAYS[0], at(15, 0, DAYS[1]), 20, 20.0), ("a", DAYS[1], at(10, 0, DAYS[1]), 5, 5.0)]
    minute = spark.createDataFrame(rows, "symbol string, trade_date date, bar_time timestamp, volume long, amount double")
    assert found(Q.off_session_bars(minute), "trade_date", "n_off", "n_other_day") == [(DAYS[0], 1, 1)]
    assert found(Q.short_sessions(minute, expected=2), "trade_date", "n_symbols", "n_short") == [(DAYS[0], 2, 1), (DAYS[1], 1, 1)]
    daily = spark.createDataFrame([("a", DAYS[0], 20, 20.0), ("b", DAYS[0], 20, 20.0), ("a", DAYS[1], 10, 5.0)], "symbol string, trade_date date, volume long, amount double")
    assert found(Q.daily_reconciliation(minute, daily, (0.9, 1.1), (0.9, 1.1), least=1), "trade_date", "volume_ratio") == [(DAYS[1], 0.5)]
    ticks = [("a", DAYS[0], 0, at(9, 25), "buy"), ("a", DAYS[0], 1, at(9, 26), "sell"), ("b", DAYS[0], 0, at(9, 40), "buy"), ("a", DAYS[1], 0, at(9, 25, DAYS[1]), "buy"), ("a", DAYS[1], 2, at(9, 31, DAYS[1]), "odd")]
    t = spark.createDataFrame(ticks, "symbol string, trade_date date, tick_seq int, trade_time timestamp, direction string")
    assert found(Q.tick_sequence_gaps(t), "symbol", "trade_date") == [("a", DAYS[1])]
    assert found(Q.off_session_ticks(t), "trade_date", "n_off") == [(DAYS[0], 1)]
    assert found(Q.truncated_sessions(t), "trade_date", "n_late") == [(DAYS[0], 1)]
    assert found(Q.direction_mix(t), "trade_date", "n_unknown", "n_buy") == [(DAYS[1], 1, 1)]


def test_macro(spark):
    s = spark.createDataFrame([("cpi", date(2024, 4, 30), 100.0), ("cpi", date(2024, 5, 31), 100.0), ("pmi", date(2024, 1, 31), 50.0)], "indicator_id string, obs_date date, value double")
    assert found(Q.macro_staleness(s, "2024-06-30"), "indicator_id", "lag_days") == [("pmi", 151)]
    new = spark.createDataFrame([("cpi", date(2024, 4, 30), 106.0), ("cpi", date(2024, 5, 31), 105.0)], s.schema)
    assert found(Q.macro_revisions(s, new), "obs_date", "new_value") == [(date(2024, 4, 30), 106.0)]


def test_integrity_of_derived_tables(spark):
    metrics = ("advance_count", "decline_count", "flat_count", "total_count")
    good = [(DAYS[0], m, v) for m, v in zip(metrics, (3.0, 2.0, 1.0, 6.0))]
    bad = [(DAYS[1], m, v) for m, v in zip(metrics, (3.0, 2.0, 1.0, 7.0))] + [(DAYS[2], m, v) for m, v in zip(metrics[:3], (1.0, 1.0, 1.0))] + [(DAYS[3], m, v) for m, v in zip((*metrics, "odd"), (1.0, 0.0, 0.0, 1.0, 9.0))]
    double = [(DAYS[4], m, v) for m, v in zip(metrics, (3.0, 2.0, 1.0, 6.0))] + [(DAYS[4], "flat_count", 1.0)]
    got = Q.breadth_integrity(spark.createDataFrame([*good, *bad, *double], "trade_date date, metric_id string, value double"), metrics)
    assert found(got, "trade_date") == [(d,) for d in DAYS[1:]]
    rows = [(DAYS[0], "i", "1", w, 3, 2, 1) for w in ("equal", "amount")] + [(DAYS[1], "i", "1", "equal", 3, 2, 1)] + [(DAYS[2], "i", "1", w, 3, 2, 0) for w in ("equal", "amount")]
    index = spark.createDataFrame(rows, "trade_date date, industry_code string, level string, weighting string, n_members long, n_priced long, n_excluded long")
    assert found(Q.index_integrity(index), "trade_date") == [(DAYS[1],), (DAYS[2],)]
    facts = spark.createDataFrame([("x", None), ("x", date(1970, 1, 1)), ("y", DAYS[0])], "source string, announce_date date")
    assert found(Q.announce_sentinels(facts), "source", "n") == [("x", 2)]


def test_every_breadth_metric_becomes_a_column(spark):
    from marketlake.plans.derive import BREADTH, breadth_counts
    from marketlake.queries import own
    from marketlake.queries.core import QUERIES

    # Limits by symbol: 0.095, 0.195 for 30* and 688*, 0.295 for BJ.
    moves = [("600001.SH", 0, 1.1), ("600002.SH", 0, 0.9), ("300001.SZ", 0, 1.1), ("830001.BJ", 0, 1.3), ("000001.SZ", 0, 1.0), ("600001.SH", 1, 0.8), ("688001.SH", 1, 0.8), ("830001.BJ", 1, 0.8)]
    table = spark.createDataFrame([(s, DAYS[d], 1.0, c) for s, d, c in moves], "symbol string, trade_date date, open double, close double")
    columns = ("trade_date", "up", "down", "flat", "total", "limit_up", "limit_down", "advance_ratio", "n")
    got = QUERIES["a21_pivot_metrics"][0](lambda name: table)
    assert found(got, *columns) == [(DAYS[0], 3, 1, 1, 5, 2, 1, 0.6, 7), (DAYS[1], 0, 3, 0, 3, 0, 2, 0.0, 7)]
    # A metric that was not stored is null and is not counted.
    fewer = breadth_counts(own._moves(lambda name: table)).where(~(F.col("metric_id").isin("limit_up_count", "advance_ratio") & (F.col("trade_date") == DAYS[1])))
    assert found(own._pivoted(fewer), *columns)[1] == (DAYS[1], 0, 3, 0, 3, None, 2, None, 5)
    assert len(BREADTH) == len(columns) - 2


def test_pivoted_metrics_are_those_of_the_long_form(spark):
    from __spark_entry__ import oracle_sql, queries

    source = "/root/testdata/sf0.001"
    ids = {"up": "advance_count", "down": "decline_count", "flat": "flat_count", "total": "total_count", "limit_up": "limit_up_count", "limit_down": "limit_down_count", "advance_ratio": "advance_ratio"}
    long = {(r["trade_date"], r["metric_id"]): r["value"] for r in queries()["a5_breadth_counts"](spark, source).collect()}
    wide = queries()["a21_pivot_metrics"](spark, source).collect()
    assert {(r["trade_date"], m): r[c] for r in wide for c, m in ids.items()} == long and len(long) == 7 * len(wide) > 0
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{source}/lineitem.parquet'")
        want = c.execute(oracle_sql()["a21_pivot_metrics"])
        names = [d[0] for d in want.description]
        assert sorted(want.fetchall()) == sorted(tuple(r[n] for n in names) for r in wide)


def test_missing_keys_and_batches(spark, sessions):
    b = bars(spark, [row("600001.SH", 0), row("600001.SH", 4), row("510001.SH", 0), row("510001.SH", 4)])
    status = spark.createDataFrame([("600001.SH", DAYS[1], False, "suspended", None, "x", None), ("600001.SH", DAYS[2], True, "normal", None, "x", None)], STATUS)
    assert found(Q.missing_keys(b, sessions, status), "symbol", "trade_date") == [("600001.SH", DAYS[2]), ("600001.SH", DAYS[3])]
    held = bars(spark, [row("a", 0, volume=0), row("b", 0, volume=0), row("c", 0), row("a", 1, volume=0), row("b", 1)])
    assert found(Q.placeholder_days(held), "trade_date") == [(DAYS[0],)]
    assert found(Q.out_of_scope(held, held.where("symbol <> 'c'")), "symbol") == [("c",)]
    marks = spark.createDataFrame([("a", DAYS[0]), ("b", DAYS[4]), ("c", None)], "dataset string, mark date")
    assert {r["dataset"] for r in Q.stale_marks(marks, DAYS[4], 2).collect()} == {"a", "c"}


def test_audit_joins_findings(spark, sessions):
    b = bars(spark, [row("a", 0), row("a", 2)])
    report = Q.audit([("daily_bars", "calendar", "error", "trade_date", lambda: Q.calendar_mismatch(b, sessions)), ("daily_bars", "gap", "warning", "symbol", lambda: Q.coverage_gaps(b, sessions))])
    rows = report.collect()
    assert sorted({(r["check_name"], r["severity"]) for r in rows}) == [("calendar", "error"), ("gap", "warning")]
    assert [r["details"]["n_missing"] for r in rows if r["check_name"] == "gap"] == ["1"] and sum(r["check_name"] == "calendar" for r in rows) == 3


def test_symbol_summary(spark):
    b = bars(spark, [row("a", 0, 1.0), row("a", 1, 2.0), row("b", 0, 3.0)])
    status = spark.createDataFrame([("a", DAYS[0], True, "normal", None, "x", datetime(2024, 6, 3)), ("a", DAYS[0], False, "suspended", None, "y", datetime(2024, 6, 4))], STATUS)
    valued = spark.createDataFrame([("a", DAYS[0], 5.0), ("a", DAYS[1], 6.0)], "symbol string, trade_date date, pe_ttm double")
    members = spark.createDataFrame([("a", "old", DAYS[0]), ("b", "old", DAYS[0]), ("a", "new", DAYS[1])], "symbol string, industry_code string, as_of_date date")
    got = {r["symbol"]: (r["bar_date"], r["close"], r["status"], r["pe_ttm"], r["industry_code"]) for r in reports.symbol_summary(b, status, valued, members).collect()}
    assert got == {"a": (DAYS[1], 2.0, "suspended", 6.0, "new"), "b": (DAYS[0], 3.0, None, None, None)}
    pages = reports.kline_pages(b, "trade_date", date(2024, 6, 1), 1)
    assert found(pages, "symbol", "trade_date") == [("a", DAYS[0]), ("a", DAYS[1]), ("b", DAYS[0])]


def test_historical_validity(spark, sessions):
    b = bars(spark, [row("600001.SH", 0), row("600001.SH", 1), row("600002.SH", 0), row("600002.SH", 4)])
    inst = spark.createDataFrame([("600001.SH", date(2000, 1, 1), None), ("600002.SH", date(2000, 1, 1), DAYS[0]), ("600003.SH", date(2000, 1, 1), DAYS[1])], "symbol string, list_date date, delist_date date")
    status = spark.createDataFrame([("600001.SH", DAYS[0], True, "normal", False, "x", None)], STATUS)
    got = {r["blocker"]: r["n"] for r in reports.historical_validity(b, inst, status, sessions).collect()}
    # The bar after delisting is outside; two pairs lack status rows; three sessions have no listed bar; one delisted name has none at all.
    assert got == {"st_evidence": 2, "interior_sessions": 3, "delisted_universe": 1}


def test_unverified_pairs_are_grouped_once(spark):
    """Repeated pairs count once, overlapping receipts of one source too; no second grouping by source."""
    from marketlake.plans import quality as Q

    day = "CAST('2024-01-0{}' AS DATE)".format
    pairs = spark.sql(f"SELECT s AS symbol, {day(2)} AS trade_date FROM VALUES ('a'), ('a'), ('b'), ('c'), ('d') t(s)")
    held = spark.sql(f"SELECT x AS source, s AS symbol, {day(2)} AS trade_date FROM VALUES ('p', 'a'), ('p', 'b'), ('q', 'b'), ('p', 'd') t(x, s)")
    receipts = spark.sql(f"SELECT x AS source, s AS symbol, 'v1' AS version, w AS window_start, {day(3)} AS window_end, n AS n_rows FROM VALUES ('p', 'a', {day(1)}, 1L), ('p', 'a', {day(2)}, 1L), "
                         f"('p', 'b', {day(1)}, 1L), ('q', 'b', {day(2)}, 1L), ('p', 'd', {day(1)}, 2L), ('z', 'c', {day(1)}, 0L) t(x, s, w, n)")  # fmt: skip
    found = Q.unverified_pairs(pairs, receipts, held, ("p", "q"), "v1")
    assert sorted((r["symbol"], r["n_sources"]) for r in found.collect()) == [("a", 1), ("c", 0), ("d", 0)]
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
