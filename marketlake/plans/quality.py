"""Data-quality queries (Q1-Q41). Each returns rows that break its rule; ``findings`` gives them one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import finite, in_bar_session, in_tick_session, relative_bps, traded, valid_bar
from ..functions.symbols import is_etf
from ..functions.symbols import code as code_of
from ..functions.symbols import exchange as exchange_of
from ..operators.asof import expected_sessions, with_neighbours
from ..operators.bars import by_symbol, gap_runs, raw_and_adjusted_returns, spans
from ..operators.ranks import grouped_median
from ..sources.lake import kept

SCHEMA = "dataset string, check_name string, severity string, subject string, details map<string,string>"


def findings(rows: DataFrame, dataset: str, check: str, severity: str, subject: str) -> DataFrame:
    """Any check's rows in the common schema; other columns become details."""
    rest = [c for c in rows.columns if c != subject]
    details = F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.col(c).cast("string") for c in rest))) if rest else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), details.alias("details"))


def audit(checks: list[tuple[str, str, str, str, Callable[[], DataFrame]]]) -> DataFrame:
    """Q41: one report of (dataset, check, severity, subject column, rows) checks."""
    return reduce(DataFrame.unionByName, (findings(make(), d, c, s, k) for d, c, s, k, make in checks))


def contract_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """Counts of broken rules over one pass."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    counts = [F.count_if(blank(c)).alias(f"blank_{c}") for c in required] + [F.count_if(~finite(F.col(c))).alias(f"not_finite_{c}") for c in floats]
    if {"open", "high", "low", "close", "volume", "amount"} <= set(df.columns):
        counts.append(F.count_if(~valid_bar()).alias("invalid_bars"))
    if "source" in df.columns:
        counts.append(F.count_if(F.col("source") == "mock").alias("mock_rows"))
    wide = df.agg(F.count("*").alias("n_rows"), *counts)
    return wide.unpivot([], wide.columns, "rule", "n")


def row_mutation(df: DataFrame, period, least_baseline: int = 50, ratio: float = 0.5) -> DataFrame:
    """Q4: periods with under half the rows or symbols of the period before."""
    per = df.groupBy(period.alias("period")).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))
    w = Window.orderBy("period")
    lagged = per.withColumn("prev_rows", F.lag("n_rows").over(w)).withColumn("prev_symbols", F.lag("n_symbols").over(w))
    fewer = (F.col("n_rows") < ratio * F.col("prev_rows")) | (F.col("n_symbols") < ratio * F.col("prev_symbols"))
    return lagged.where((F.col("prev_rows") >= least_baseline) & fewer)


def fragmentation(files: DataFrame, least_partitions: int = 30, rows_each: int = 50) -> DataFrame:
    """Q5: datasets of many partitions with few rows each, from (dataset, partition, n_rows)."""
    per = files.groupBy("dataset").agg(F.countDistinct("partition").alias("n_partitions"), F.sum("n_rows").alias("n_rows"))
    return per.where((F.col("n_partitions") >= least_partitions) & (F.col("n_rows") < rows_each * F.col("n_partitions")))


def calendar_mismatch(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q6: bar dates that are no session, and sessions without bars."""
    days, open_ = bars.select("trade_date").distinct(), sessions.select("trade_date")
    orphan = days.join(F.broadcast(open_), "trade_date", "left_anti").select("trade_date", F.lit("orphan").alias("problem"))
    return orphan.unionByName(open_.join(days, "trade_date", "left_anti").select("trade_date", F.lit("missing_day").alias("problem")))


def calendar_horizon(calendar: DataFrame, last_known) -> DataFrame:
    """Q7: calendar days beyond the holiday table."""
    return calendar.where(F.col("trade_date") > F.lit(last_known).cast("date")).select("trade_date")


def session_coverage(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q8: per symbol, sessions of its own span without a bar and bars off any session."""
    own = spans(bars)
    have = bars.select("symbol", "trade_date").distinct()
    missing = expected_sessions(own, sessions, "first_bar", "last_bar").join(have, ["symbol", "trade_date"], "left_anti").groupBy("symbol").agg(F.count("*").alias("n_missing"))
    orphan = have.join(F.broadcast(sessions.select("trade_date")), "trade_date", "left_anti").groupBy("symbol").agg(F.count("*").alias("n_orphan"))
    both = missing.join(orphan, "symbol", "full_outer")
    return both.select("symbol", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("n_orphan", F.lit(0)).alias("n_orphan"))


def valuation_coverage(valuations: DataFrame, bars: DataFrame, least: float = 0.7) -> DataFrame:
    """Q9: days on which too few traded symbols have a valuation."""
    have = bars.where(traded()).select("symbol", "trade_date").distinct()
    seen = valuations.select("symbol", "trade_date", F.lit(1).alias("_v")).distinct()
    per = have.join(seen, ["symbol", "trade_date"], "left").groupBy("trade_date").agg(F.count("*").alias("n_bars"), F.count("_v").alias("n_valued"))
    return per.withColumn("coverage", F.col("n_valued") / F.col("n_bars")).where(F.col("coverage") < least)


def factor_coverage(bars: DataFrame, factors: DataFrame, least: float = 0.98) -> DataFrame:
    """Q10, A10: exchanges where too few symbols have a factor on every bar date."""
    bare = bars.select("symbol", "trade_date").join(factors.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti").groupBy("symbol").agg(F.count("*").alias("n_bare"))
    per = bars.select("symbol").distinct().join(bare, "symbol", "left").groupBy(exchange_of(F.col("symbol")).alias("exchange"))
    out = per.agg(F.count("*").alias("n_symbols"), F.count_if(F.col("n_bare").isNull()).alias("n_covered"))
    return out.withColumn("share", F.col("n_covered") / F.col("n_symbols")).where(F.col("share") < least)


def adjusted_breaks(bars: DataFrame, sessions: DataFrame, limit: float = 0.35) -> DataFrame:
    """Q11: adjusted returns that break where raw ones do not, on adjacent sessions; the worst per symbol."""
    r = raw_and_adjusted_returns(bars).join(F.broadcast(with_neighbours(sessions).select("trade_date", F.col("prev_date").alias("_prev"))), "trade_date").where("prev_date = _prev")
    bad = r.withColumn("divergence", F.abs(F.col("adj_ret") - F.col("raw_ret"))).where((F.abs("adj_ret") > limit) & (F.col("divergence") > limit))
    return worst_per(bad, "symbol", "divergence", ["trade_date", "adj_ret", "raw_ret"])


def worst_per(df: DataFrame, key: str, severity: str, keep: list[str]) -> DataFrame:
    """The most severe row of each key and the number of rows."""
    best = F.max_by(F.struct(*keep), F.struct(severity, *keep))
    return df.groupBy(key).agg(best.alias("_w"), F.max(severity).alias(severity), F.count("*").alias("n_found")).select(key, severity, "n_found", "_w.*")


def missing_actions(bars: DataFrame, actions: DataFrame, quiet: float = 0.15, gap: float = 0.11) -> DataFrame:
    """Adjusted price continuous, raw price not, and no ex-date since the previous bar."""
    r = raw_and_adjusted_returns(bars).withColumn("divergence", F.abs(F.col("adj_ret") - F.col("raw_ret")))
    odd = r.where((F.abs("adj_ret") <= quiet) & (F.col("divergence") > gap))
    ex = actions.select("symbol", F.col("ex_date").alias("_ex")).distinct()
    return odd.join(ex, (odd.symbol == ex.symbol) & (F.col("_ex") > F.col("prev_date")) & (F.col("_ex") <= F.col("trade_date")), "left_anti")


def factor_steps(factors: DataFrame, most: float = 20.0) -> DataFrame:
    """Steps of over 20 times or under a 20th."""
    w = Window.partitionBy("symbol", "adjust_type").orderBy("trade_date")
    step = F.try_divide("factor", F.lag("factor").over(w))
    return factors.withColumn("step", step).where((F.col("step") > most) | (F.col("step") < 1 / most))


def factor_crosscheck(bars: DataFrame, actions: DataFrame, tolerance_bps: float = 50.0) -> DataFrame:
    """Factor steps against those the ex-rights formula expects."""
    w = by_symbol()
    prev = bars.select("symbol", "trade_date", "factor", F.lag("factor").over(w).alias("prev_factor"), F.lag("close").over(w).alias("prev_close"))
    terms = actions.groupBy("symbol", F.col("ex_date").alias("trade_date")).agg(
        F.sum("cash_dividend").alias("cash"), F.sum("bonus_ratio").alias("bonus"), F.sum("transfer_ratio").alias("transfer"),
        F.sum("allotment_ratio").alias("allotment"), F.sum(F.col("allotment_ratio") * F.coalesce("allotment_price", F.lit(0.0))).alias("paid"),
    )
    both = prev.join(terms, ["symbol", "trade_date"]).where("prev_factor IS NOT NULL")
    reference = (F.col("prev_close") - F.col("cash") + F.col("paid")) / (1 + F.col("bonus") + F.col("transfer") + F.col("allotment"))
    both = both.withColumn("reference", reference).withColumn("actual", F.try_divide("factor", "prev_factor")).withColumn("expected", F.try_divide("prev_close", "reference"))
    both = both.withColumn("bps", relative_bps(F.col("actual"), F.col("expected"))).withColumn("degenerate", F.col("reference") <= 0)
    return both.where(F.col("degenerate") | (F.col("bps") > tolerance_bps)).select("symbol", "trade_date", "actual", "expected", "bps", "degenerate")


def survivorship(bars: DataFrame, instruments: DataFrame, quiet_days: int = 180, least_span: int = 730) -> DataFrame:
    """Q15: symbols silent long before the lake's end; of these, the ones without a delist date."""
    ends = bars.agg(F.max("trade_date").alias("lake_end"), F.min("trade_date").alias("lake_start"))
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("last_bar")).crossJoin(F.broadcast(ends))
    quiet = last.where((F.datediff("lake_end", "last_bar") > quiet_days) & (F.datediff("lake_end", "lake_start") >= least_span))
    return quiet.join(instruments.select("symbol", "delist_date"), "symbol", "left").select("symbol", "last_bar", F.col("delist_date").isNull().alias("undated"))


def close_mismatch(bars: DataFrame, reference: DataFrame, n: int = 12, tolerance: float = 0.001) -> DataFrame:
    """Q16, T5: of each day's n most traded symbols, closes off the reference."""
    w = Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol")
    liquid = bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    both = liquid.join(reference.select("symbol", "trade_date", F.col("close").alias("ref_close")), ["symbol", "trade_date"])
    return both.where(F.abs(F.col("close") - F.col("ref_close")) > tolerance * F.abs("ref_close")).select("symbol", "trade_date", "close", "ref_close")


def st_labels(status: DataFrame, instruments: DataFrame) -> DataFrame:
    """Q17: latest risk_warning against the short name's prefix."""
    latest = status.groupBy("symbol").agg(F.max_by(F.coalesce("risk_warning", F.lit(False)), F.struct("trade_date", "fetched_at", "source")).alias("labelled"))
    named = instruments.select("symbol", F.coalesce(F.col("name").rlike(r"^\*?ST"), F.lit(False)).alias("named"))
    return latest.join(named, "symbol", "full_outer").select("symbol", F.coalesce("labelled", F.lit(False)).alias("labelled"), F.coalesce("named", F.lit(False)).alias("named")).where("labelled <> named")


def volume_unit(bars: DataFrame, low: float = 0.8, high: float = 1.25, least: int = 200) -> DataFrame:
    """Sources whose median of amount / close / volume is off 1."""
    ratio = F.try_divide(F.try_divide("amount", "close"), F.col("volume").cast("double"))
    whole = kept(bars.where("volume > 0").select("source", ratio.alias("ratio")), "ratios")
    sizes = whole.groupBy("source").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)
    middle = grouped_median(whole, "source", "ratio", kept).select(F.col("source").alias("_source"), F.col("median").alias("median_ratio"))
    per = sizes.join(middle, F.col("source").eqNullSafe(F.col("_source"))).select("source", "median_ratio", "n_rows")
    return per.where((F.col("median_ratio") < low) | (F.col("median_ratio") > high))


def amount_completeness(bars: DataFrame, least: int = 20) -> DataFrame:
    """Share of missing amounts by source."""
    per = bars.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("amount").isNull()).alias("n_null")).where(F.col("n_rows") >= least)
    return per.withColumn("null_share", F.col("n_null") / F.col("n_rows")).where("n_null > 0")


def off_session_bars(bars: DataFrame) -> DataFrame:
    """Q20: per day, bars outside the session and bars stamped on another date."""
    return bars.groupBy("trade_date").agg(F.count_if(~in_bar_session(F.col("bar_time"))).alias("n_off"), F.count_if(F.col("bar_time").cast("date") != F.col("trade_date")).alias("n_other_day")).where("n_off + n_other_day > 0")


def short_sessions(bars: DataFrame, expected: int = 240, share: float = 0.9, flagged: float = 0.2) -> DataFrame:
    """Q21: days on which many symbols have too few bars."""
    per = bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"))
    days = per.groupBy("trade_date").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("n") < share * expected).alias("n_short"))
    return days.where(F.col("n_short") >= flagged * F.col("n_symbols"))


def daily_reconciliation(fine: DataFrame, daily: DataFrame, volume_band: tuple[float, float], amount_band: tuple[float, float], least: int = 20, amount=None) -> DataFrame:
    """Days whose median ratio of summed to daily volume or amount is out of band."""
    total = fine.groupBy("symbol", "trade_date").agg(F.sum("volume").alias("_v"), F.sum(amount if amount is not None else F.col("amount")).alias("_a"))
    both = total.join(daily.select("symbol", "trade_date", "volume", "amount"), ["symbol", "trade_date"])
    per = both.groupBy("trade_date").agg(
        F.median(F.try_divide(F.col("_v").cast("double"), F.col("volume").cast("double"))).alias("volume_ratio"), F.median(F.try_divide("_a", "amount")).alias("amount_ratio"), F.count("*").alias("n")
    )
    out = ~F.col("volume_ratio").between(*volume_band) | ~F.col("amount_ratio").between(*amount_band)
    return per.where((F.col("n") >= least) & out)


def tick_sequence_gaps(ticks: DataFrame) -> DataFrame:
    """Q23: symbol-days whose sequence is not 0..n-1."""
    per = ticks.groupBy("symbol", "trade_date").agg(F.min("tick_seq").alias("lo"), F.max("tick_seq").alias("hi"), F.count("*").alias("n"), F.countDistinct("tick_seq").alias("n_distinct"))
    return per.where("lo <> 0 OR hi <> n - 1 OR n_distinct <> n")


def off_session_ticks(ticks: DataFrame) -> DataFrame:
    """Q24."""
    return ticks.groupBy("trade_date").agg(F.count_if(~in_tick_session(F.col("trade_time"))).alias("n_off"), F.count_if(F.col("trade_time").cast("date") != F.col("trade_date")).alias("n_other_day")).where("n_off + n_other_day > 0")


def truncated_sessions(ticks: DataFrame, opening: str = "09:25:59", share: float = 0.1) -> DataFrame:
    """Q25: days on which many symbols' first tick comes after the opening auction."""
    first = ticks.groupBy("symbol", "trade_date").agg(F.date_format(F.min("trade_time"), "HH:mm:ss").alias("first"))
    per = first.groupBy("trade_date").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("first") > opening).alias("n_late"))
    return per.where(F.col("n_late") >= share * F.col("n_symbols"))


def direction_mix(ticks: DataFrame, known: tuple[str, ...] = ("buy", "sell", "neutral")) -> DataFrame:
    """Q26: days with unknown codes or a one-sided buy share."""
    per = ticks.groupBy("trade_date").agg(F.count_if(~F.col("direction").isin(*known)).alias("n_unknown"), F.count_if(F.col("direction") == "buy").alias("n_buy"), F.count_if(F.col("direction").isin("buy", "sell")).alias("n_sided"))
    per = per.withColumn("buy_share", F.try_divide("n_buy", "n_sided"))
    return per.where((F.col("n_unknown") > 0) | (F.col("buy_share") > 0.9) | (F.col("buy_share") < 0.1))


def macro_staleness(series: DataFrame, as_of, most_days: int = 45) -> DataFrame:
    """Q28: indicators whose last observation is old."""
    last = series.groupBy("indicator_id").agg(F.max("obs_date").alias("last_obs"))
    return last.withColumn("lag_days", F.datediff(F.lit(as_of).cast("date"), F.col("last_obs"))).where(F.col("lag_days") > most_days)


def macro_revisions(stored: DataFrame, incoming: DataFrame, share: float = 0.05) -> DataFrame:
    """Incoming values that revise a stored one by more than the share."""
    both = stored.join(incoming.select("indicator_id", "obs_date", F.col("value").alias("new_value")), ["indicator_id", "obs_date"])
    return both.where(F.abs(F.col("new_value") - F.col("value")) > share * F.abs("value")).select("indicator_id", "obs_date", "value", "new_value")


def breadth_metrics(breadth: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row per day with a column per metric (null where it is missing), the number of rows and of distinct and unknown metrics."""
    value = (F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(m) for m in metrics)
    return breadth.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.countDistinct("metric_id").alias("n_distinct"), F.count_if(~F.col("metric_id").isin(*metrics)).alias("n_unknown"), *value
    )


def breadth_integrity(breadth: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Q29: days with unknown, missing, duplicate or inconsistent metrics."""
    parts, total = F.col("advance_count") + F.col("decline_count") + F.col("flat_count"), F.col("total_count")
    per = breadth_metrics(breadth, metrics).select("trade_date", "n", "n_distinct", "n_unknown", parts.alias("parts"), total.alias("total"))
    return per.where((F.col("n_unknown") > 0) | (F.col("n_distinct") < len(metrics)) | (F.col("n") > F.col("n_distinct")) | (F.col("parts") != F.col("total")))


def index_integrity(index: DataFrame) -> DataFrame:
    """Q30: groups without both weightings, duplicates, or counts that do not add up."""
    per = index.groupBy("trade_date", "industry_code", "level").agg(
        F.countDistinct("weighting").alias("n_weightings"), F.count("*").alias("n_rows"), F.count_if(F.col("n_priced") + F.col("n_excluded") != F.col("n_members")).alias("n_off")
    )
    return per.where("n_weightings <> 2 OR n_rows <> 2 OR n_off > 0")


def announce_sentinels(facts: DataFrame, sentinels: tuple[str, ...] = ("1900-01-01", "1970-01-01", "2099-12-31")) -> DataFrame:
    """Q31: facts without a real announce date, by source."""
    bad = F.col("announce_date").isNull() | F.col("announce_date").cast("string").isin(*sentinels)
    return facts.where(bad).groupBy("source").agg(F.count("*").alias("n"))


def source_diff(primary: DataFrame, backup: DataFrame, key: list[str], fields: list[str], tolerance_bps: float) -> DataFrame:
    """Rows only one side has, fields null on one side, fields further apart than the tolerance."""
    p = primary.select(*key, *(F.col(c).alias(f"p_{c}") for c in fields), F.lit(True).alias("_p"))
    b = backup.select(*key, *(F.col(c).alias(f"b_{c}") for c in fields), F.lit(True).alias("_b"))
    both = p.join(b, key, "full_outer")
    each = lambda c: F.when(F.col(f"p_{c}").isNull() != F.col(f"b_{c}").isNull(), "null_mismatch").when(relative_bps(F.col(f"p_{c}"), F.col(f"b_{c}")) > tolerance_bps, "drift")
    side = F.when(F.col("_p").isNull(), "only_backup").when(F.col("_b").isNull(), "only_primary")
    states = F.when(side.isNotNull(), F.array(F.struct(F.lit("*").alias("field"), side.alias("state")))).otherwise(F.array(*(F.struct(F.lit(c).alias("field"), each(c).alias("state")) for c in fields)))
    return both.select(*key, F.inline(F.filter(states, lambda x: x["state"].isNotNull())))


def diff_gate(diff: DataFrame, compared: int, most: float) -> DataFrame:
    """Q32: states whose share of the compared keys is above the gate."""
    return diff.groupBy("field", "state").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(compared)).where(F.col("share") > most)


def publisher_drift(bars: DataFrame, official: DataFrame, fields: list[str], tolerance_bps: float) -> DataFrame:
    """The worst drift of each row against the official table."""
    both = bars.join(official.select("symbol", "trade_date", *(F.col(c).alias(f"o_{c}") for c in fields)), ["symbol", "trade_date"])
    worst = F.greatest(*(relative_bps(F.col(c), F.col(f"o_{c}")) for c in fields), F.lit(0.0))
    return both.withColumn("worst_bps", worst).where(F.col("worst_bps") > tolerance_bps).select("symbol", "trade_date", "worst_bps")


def evidence_gaps(pairs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Q34: (symbol, date) pairs that no receipt's window covers; overlapping receipts add up."""
    r = receipts.select(F.col("symbol").alias("_s"), "window_start", "window_end")
    return pairs.join(r, (F.col("symbol") == F.col("_s")) & F.col("trade_date").between(F.col("window_start"), F.col("window_end")), "left_anti")


def intact_receipts(receipts: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Q34: receipts of the current version whose rows are still stored: as many (source, symbol) rows inside the window as it counted."""
    key = ["source", "symbol", "window_start", "window_end", "n_rows"]
    current = receipts.where(F.col("version") == version).select(*key).distinct().alias("r")
    rows = stored.select("source", "symbol", "trade_date").distinct().alias("s")
    inside = (F.col("r.source") == F.col("s.source")) & (F.col("r.symbol") == F.col("s.symbol")) & F.col("s.trade_date").between(F.col("r.window_start"), F.col("r.window_end"))
    held = current.join(rows, inside, "left").groupBy(*(F.col(f"r.{k}") for k in key)).agg(F.count("s.trade_date").alias("held"))
    return held.where("held = n_rows").select(*key)


def unverified_pairs(pairs: DataFrame, receipts: DataFrame, stored: DataFrame, sources: tuple[str, ...], version: str) -> DataFrame:
    """Q34: pairs that not every required source has an intact receipt for, with the number that do; overlapping receipts count once."""
    good = intact_receipts(receipts.where(F.col("source").isin(*sources)), stored, version).alias("r")
    inside = (F.col("p.symbol") == F.col("r.symbol")) & F.col("p.trade_date").between(F.col("r.window_start"), F.col("r.window_end"))
    # Grouping makes repeated pairs one, and a flag for each source needs no second grouping by source.
    seen = pairs.select("symbol", "trade_date").alias("p").join(good, inside, "left")
    required = list(dict.fromkeys(sources))
    held = seen.groupBy("p.symbol", "p.trade_date").agg(*(F.max(F.coalesce((F.col("r.source") == x).cast("long"), F.lit(0))).alias(f"_{i}") for i, x in enumerate(required)))
    counted = held.select("symbol", "trade_date", sum((F.col(f"_{i}") for i in range(len(required))), F.lit(0).cast("long")).alias("n_sources"))
    return counted.where(F.col("n_sources") < len(sources))


def coverage_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Interior runs of missing sessions per symbol."""
    return gap_runs(expected_sessions(spans(bars), sessions, "first_bar", "last_bar"), bars, ["symbol"])


def stale_marks(marks: DataFrame, anchor, tolerance_days: int) -> DataFrame:
    """Q36: datasets whose mark lags the anchor."""
    return marks.withColumn("lag_days", F.datediff(F.lit(anchor).cast("date"), F.col("mark"))).where(F.col("mark").isNull() | (F.col("lag_days") > tolerance_days))


def heatmap(bars: DataFrame, sessions: DataFrame, key: str = "symbol") -> DataFrame:
    """Q37: per key and month, sessions covered and missed inside its span."""
    cells = expected_sessions(spans(bars), sessions, "first_bar", "last_bar").join(bars.select("symbol", "trade_date", F.lit(1).alias("_c")).distinct(), ["symbol", "trade_date"], "left")
    return cells.groupBy(key, F.trunc("trade_date", "month").alias("month")).agg(F.count("_c").alias("covered"), F.count_if(F.col("_c").isNull()).alias("missed"))


def out_of_scope(batch: DataFrame, scope: DataFrame) -> DataFrame:
    """Q38: batch rows of symbols that were not asked for."""
    return batch.join(scope.select("symbol").distinct(), "symbol", "left_anti")


def missing_keys(bars: DataFrame, sessions: DataFrame, status: DataFrame) -> DataFrame:
    """Q39: expected (symbol, session) pairs without a bar that no non-trading status explains; funds are out."""
    want = expected_sessions(spans(bars), sessions, "first_bar", "last_bar").where(~is_etf(code_of(F.col("symbol")), exchange_of(F.col("symbol"))))
    gone = want.join(bars.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
    quiet = status.where(F.col("status").isin("suspended", "delisted", "not_listed")).select("symbol", "trade_date")
    return gone.join(quiet, ["symbol", "trade_date"], "left_anti").select("symbol", "trade_date")


def placeholder_days(bars: DataFrame, most: float = 0.5) -> DataFrame:
    """Q40: days whose rows are mostly placeholders (volume 0)."""
    per = bars.groupBy("trade_date").agg(F.count("*").alias("n"), F.count_if(F.col("volume") == 0).alias("n_placeholder"))
    return per.where(F.col("n_placeholder") > most * F.col("n"))


