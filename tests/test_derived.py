"""Derived jobs against small tables worked out by hand from their rules."""

from datetime import date

from pyspark.sql import functions as F

from marketlake.plans import derive

D = [date(2024, 6, d) for d in range(1, 31)]
STATUS = "symbol string, trade_date date, is_trading boolean, status string, risk_warning boolean"


def pairs(df, a, b):
    return {(r[a], r[b]) for r in df.collect()}


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume long, amount double")


def test_ownership(spark):
    inst = spark.createDataFrame(
        [
            ("600001.SH", date(2024, 7, 1), None, "stock"), ("600002.SH", date(2000, 1, 1), date(2024, 5, 1), "stock"), ("600003.SH", date(2000, 1, 1), D[4], "stock"), ("510001.SH", None, D[4], "etf"),
            ("600004.SH", date(2000, 1, 1), None, "stock"), ("600005.SH", date(2000, 1, 1), None, "stock"), ("600006.SH", None, None, "stock"), ("600007.SH", date(2000, 1, 1), None, None),
            ("600008.SH", date(2000, 1, 1), None, "stock"), ("600009.SH", date(2000, 1, 1), None, "stock"), ("600010.SH", None, None, "stock"), ("600011.SH", date(2000, 1, 1), None, "stock"),
        ],
        "symbol string, list_date date, delist_date date, asset_type string",
    )
    sessions = spark.createDataFrame([(D[2],), (D[3],), (D[4],)], "trade_date date")
    status = [("600004.SH", d, False, "suspended", None) for d in D[2:5]] + [("600005.SH", D[2], False, "suspended", None)] + [("600010.SH", D[3], True, "normal", None), ("600009.SH", D[3], True, "normal", None)]
    evidence = spark.createDataFrame([("600008.SH", D[0], D[9]), ("600009.SH", D[0], D[9]), ("600011.SH", D[3], D[9])], "symbol string, start_date date, end_date date")
    asked = inst.select("symbol").unionByName(spark.createDataFrame([("699999.SH",)], "symbol string"))
    bars = bars_of(spark, [("600001.SH", D[0], 1.0, 1, 1.0)])
    got = pairs(derive.ownership(asked, inst, bars, spark.createDataFrame(status, STATUS), sessions, D[2], D[4], evidence), "symbol", "ownership")
    assert got == {
        ("600001.SH", "not_listed"), ("600002.SH", "delisted_before_window"), ("600003.SH", "delegated_delisted"), ("510001.SH", "generic"), ("600004.SH", "non_trading"), ("600005.SH", "unknown"),
        ("600006.SH", "placeholder"), ("600007.SH", "unknown"), ("600008.SH", "negative_evidence"), ("600009.SH", "generic"), ("600010.SH", "placeholder"), ("600011.SH", "generic"), ("699999.SH", "unknown"),
    }
    assert derive.ownership(asked.where("false"), inst, bars, spark.createDataFrame(status, STATUS), sessions, D[2], D[4]).count() == 0


def test_delisted_coverage(spark):
    catalog = spark.createDataFrame([("a", D[9]), ("b", D[9]), ("c", D[9]), ("d", D[9]), ("e", date(2024, 8, 1)), ("f", date(2024, 8, 1)), ("g", date(2023, 1, 1)), ("x", D[9])], "symbol string, last_traded date")
    inst = spark.createDataFrame(
        [("a", D[9]), ("b", D[10]), ("c", None), ("d", D[12]), ("f", date(2024, 9, 1)), ("g", D[5]), ("h", D[5]), ("i", D[5])], "symbol string, delist_date date"
    )
    bars = bars_of(spark, [("a", D[9], 1.0, 1, 1.0), ("a", D[10], 1.0, 0, 0.0), ("b", D[7], 1.0, 1, 1.0), ("c", D[9], 1.0, 1, 1.0), ("d", D[2], 1.0, 1, 1.0), ("f", D[3], 1.0, 1, 1.0), ("i", D[8], 1.0, 1, 1.0)])
    recent = spark.createDataFrame([("r", D[3]), ("s", date(2025, 1, 1))], "symbol string, last_traded date")
    got = pairs(derive.delisted_coverage(catalog, inst, bars, D[0], D[29], recent), "symbol", "finding")
    assert got == {
        ("a", "complete"), ("b", "terminal_nonprinting"), ("c", "invalid_delist_date"), ("d", "terminal_mismatch"), ("e", "unknown_overlap"), ("f", "complete"), ("g", "formal_no_overlap"),
        ("h", "formal_unresolved"), ("i", "invalid_delist_date"), ("x", "missing_bars"), ("x", "missing_instrument"), ("r", "recent_quarantined"),
    }


def test_plans(spark):
    text = "symbol string, ex_date date, plan string, progress string"
    rows = [("a", D[0], "10送3股转增5股派1.5元", "实施方案"), ("b", D[0], "10派2元", "预案"), ("c", D[0], "不分配", "实施方案"), ("d", D[0], "10股 配 3股，配股价 5.5元", "实施方案公告"), ("e", D[0], "10转2转增1", "实施方案"), ("f", None, "10派1", "实施方案"), ("g", D[0], None, "实施方案")]
    got = {(r["symbol"], r["action_type"]): (round(r["per_share"], 9), r["allotment_price"]) for r in derive.plan_actions(spark.createDataFrame(rows, text)).collect()}
    assert got == {("a", "bonus"): (0.3, None), ("a", "transfer"): (0.5, None), ("a", "cash_dividend"): (0.15, None), ("d", "allotment"): (0.3, 5.5), ("e", "transfer"): (0.3, None)}
    schema = "symbol string, ex_date date, cash_per_10 double, bonus_per_10 double, transfer_per_10 double, combined_per_10 double, plan_text string"
    plans = spark.createDataFrame(
        [("a", D[0], 1.0, None, None, 4.0, "10转4派1"), ("b", D[0], None, None, None, 4.0, "10送4"), ("c", D[0], None, 2.0, None, 9.0, None), ("d", D[0], None, None, None, None, "10派现金"), ("e", D[0], 0.0, None, None, None, "10送转")], schema
    )
    got = {(r["symbol"], r["action_type"], round(r["per_share"], 9)) for r in derive.action_rows(plans).collect()}
    assert got == {("a", "cash_dividend", 0.1), ("a", "transfer", 0.4), ("b", "bonus", 0.4), ("c", "bonus", 0.2)}
    assert {r["symbol"] for r in derive.unreadable_plans(plans).collect()} == {"d", "e"}


def test_market_value(spark):
    bars = spark.createDataFrame([("a", D[4], 10.0, 500.0, 2.0), ("a", D[0], 10.0, 500.0, 0.0), ("b", D[4], 1.0, None, 1.0)], "symbol string, trade_date date, close double, amount double, turnover_pct double")
    shares = spark.createDataFrame([("a", D[1], 7.0), ("a", D[2], 0.0)], "symbol string, change_date date, total_shares double")
    got = {(r["symbol"], r["trade_date"]): (r["total_mv"], r["float_mv"]) for r in derive.market_value(bars, shares).collect()}
    assert got == {("a", D[4]): (70.0, 25000.0), ("a", D[0]): (None, None), ("b", D[4]): (None, None)}


def test_retired_names(spark):
    rows = [("600001.SH", D[0], 1.0, 1, 1.0), ("600002.SH", D[0], 1.0, 1, 1.0), ("600003.SH", D[0], 1.0, 1, 1.0), ("600004.SH", D[29], 1.0, 1, 1.0), ("510001.SH", D[0], 1.0, 1, 1.0)]
    rows += [("600002.SH", D[i], 1.0, 0, 0.0) for i in range(1, 6)] + [("600001.SH", D[1], 1.0, 0, 0.0)] * 6
    inst = spark.createDataFrame([("600003.SH", D[3])], "symbol string, delist_date date")
    catalog = spark.createDataFrame([("600003.SH", D[2]), ("600009.SH", D[2])], "symbol string, last_traded date")
    got = {tuple(r) for r in derive.retired_names(bars_of(spark, rows), inst, catalog, quiet_days=10, placeholders=5).collect()}
    assert got == {("600001.SH", D[0], D[0]), ("600003.SH", D[0], D[2]), ("600009.SH", None, D[2])}


def test_assemble_status(spark):
    inst = spark.createDataFrame([("a", None, None), ("b", None, D[3]), ("c", D[4], None)], "symbol string, list_date date, delist_date date")
    days = spark.createDataFrame([(D[1],), (D[2],), (D[20],)], "trade_date date")
    live = spark.createDataFrame([("a", D[1], True, "normal", False), ("b", D[1], True, "normal", False), ("a", D[2], True, "normal", False), ("a", D[20], True, "normal", False), ("c", D[20], True, "normal", None), ("z", D[20], True, "normal", None)], STATUS)
    history = spark.createDataFrame([("a", D[0], True, "normal", True), ("b", date(2024, 5, 1), True, "normal", None)], STATUS)
    lack = {r["trade_date"]: (r["n_missing"], r["n_unexpected"]) for r in derive.status_presence(live, inst, days).collect()}
    assert lack == {D[1]: (0, 0), D[2]: (1, 0), D[20]: (0, 1)}
    got = {(r["symbol"], r["trade_date"]): (r["is_trading"], r["status"], r["risk_warning"], r["source"]) for r in derive.assemble_status(live, history, inst, days).collect()}
    assert got == {
        ("a", D[1]): (True, "normal", False, "eastmoney"), ("b", D[1]): (True, "normal", False, "eastmoney"), ("c", D[1]): (False, "not_listed", None, "derived_not_listed"),
        ("a", D[2]): (True, "normal", True, "eastmoney_cached"), ("b", D[2]): (False, "suspended", None, "eastmoney_cached"), ("c", D[2]): (False, "not_listed", None, "derived_not_listed"),
        ("b", D[20]): (False, "delisted", None, "derived_delisted"),
    }


def test_symbol_priority(spark):
    hot = spark.createDataFrame([("a", D[0], 2), ("b", D[0], 1), ("z", date(2024, 5, 1), 1)], "symbol string, trade_date date, rank int")
    told = spark.createDataFrame([("a", D[4]), ("d", D[4]), ("c", D[4]), ("y", D[3])], "symbol string, announce_date date")
    bars = bars_of(spark, [("e", D[4], 1.0, 1, 5.0), ("f", D[4], 1.0, 1, 9.0), ("g", D[4], 1.0, 0, 99.0), ("h", D[4], 1.0, 1, None)])
    assert [r["symbol"] for r in derive.symbol_priority(hot, told, bars, D[4], 6).collect()] == ["b", "a", "c", "d", "f", "e"]
    assert [r["symbol"] for r in derive.symbol_priority(hot.where("false"), told, bars, D[4], 2).collect()] == ["a", "c"]


def test_factor_refresh(spark):
    bars = bars_of(spark, [(s, d, 1.0, 1, 1.0) for s in ("600001.SH", "600002.SH", "600003.SH", "600004.SH", "689009.SH") for d in D[:3]])
    rows = [("600001.SH", d, "hfq", 1.0) for d in D[:3]] + [("600002.SH", d, "hfq", 1.0) for d in D[:2]] + [("600003.SH", d, "hfq", 1.0) for d in (D[0], D[2])] + [("600004.SH", D[1], "hfq", 1.0)]
    factors = spark.createDataFrame(rows, "symbol string, trade_date date, adjust_type string, factor double")
    inst = spark.createDataFrame([(s, "stock", None) for s in ("600001.SH", "600002.SH", "600003.SH", "600004.SH", "689009.SH")] + [("600005.SH", "stock", D[2])], "symbol string, asset_type string, list_date date")
    actions = spark.createDataFrame([("600001.SH", D[1])], "symbol string, ex_date date")
    due = lambda day: {r["symbol"] for r in derive.symbols_to_refresh(bars, factors, actions, inst, day).collect()}
    assert due(D[1]) == {"600001.SH", "600003.SH", "600004.SH"}
    assert due(D[2]) == {"600003.SH", "600004.SH", "600005.SH"}
    refresh = spark.createDataFrame([("600001.SH",)], "symbol string")
    run = pairs(derive.bars_to_derive(bars, factors, refresh, D[1], 1), "symbol", "trade_date")
    assert run == {(s, D[2]) for s in ("600001.SH", "600002.SH", "600003.SH", "600004.SH", "689009.SH")} | {("600001.SH", D[0]), ("600001.SH", D[1]), ("600003.SH", D[1])}


def test_spot_check(spark):
    bars = bars_of(spark, [("a", D[0], 10.0, 1, 1.0), ("a", D[1], 10.0, 1, 1.0), ("a", D[2], 10.0, 1, 1.0)])
    picks = bars.where(F.col("trade_date") < D[2]).select("symbol", "trade_date")
    schema = "symbol string, trade_date date, adjust_type string, factor double"
    both = spark.createDataFrame([("a", D[0], "hfq", 2.0), ("a", D[1], "qfq", 0.5)], schema)
    get = lambda f: sorted((r["trade_date"], r["adj_close"], r["adjust_type"]) for r in derive.spot_check(bars, f, picks).collect())
    assert get(both) == [(D[0], 20.0, "hfq"), (D[1], 10.0, "hfq")]
    assert get(both.where("adjust_type = 'qfq'")) == [(D[0], 10.0, "qfq"), (D[1], 5.0, "qfq")]
    assert [x[1:] for x in get(both.where("false"))] == [(10.0, None), (10.0, None)]


def test_weekend_bars_do_not_hide_the_previous_session(spark):
    from marketlake.operators.bars import previous_session

    bars = bars_of(spark, [("a", D[0], 1.0, 0, 0.0), ("a", D[1], 9.0, 1, 1.0), ("a", D[2], 3.0, 1, 1.0), ("a", D[5], 4.0, 1, 1.0)])
    sessions = spark.createDataFrame([(D[0], None), (D[2], D[0]), (D[4], D[2]), (D[5], D[4])], "trade_date date, prev_date date")
    assert [(r["trade_date"], r["prev_close"]) for r in previous_session(bars, sessions).collect()] == [(D[2], 1.0)]


def test_unverified_pairs(spark):
    from marketlake.plans.quality import unverified_pairs

    pairs_ = spark.createDataFrame([("a", d) for d in D[:4]] + [("b", D[0])], "symbol string, trade_date date")
    stored = spark.createDataFrame([("x", "a", d) for d in D[:4]] + [("y", "a", d) for d in D[:2]], "source string, symbol string, trade_date date")
    rows = [("x", "a", "v2", D[0], D[1], 2), ("x", "a", "v2", D[1], D[3], 3), ("y", "a", "v2", D[0], D[0], 1), ("y", "a", "v2", D[1], D[2], 2), ("y", "a", "v1", D[0], D[3], 2), ("z", "a", "v2", D[0], D[3], 0)]
    receipts = spark.createDataFrame(rows, "source string, symbol string, version string, window_start date, window_end date, n_rows long")
    got = {(r["symbol"], r["trade_date"]): r["n_sources"] for r in unverified_pairs(pairs_, receipts, stored, ("x", "y"), "v2").collect()}
    assert got == {("a", D[1]): 1, ("a", D[2]): 1, ("a", D[3]): 1, ("b", D[0]): 0}
