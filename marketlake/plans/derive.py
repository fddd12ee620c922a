"""Derived tables (D1-D20, D26-D52) as DataFrame jobs over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import industry_level, safe_turnover, traded
from ..functions.symbols import LEGACY_ST, is_cdr, is_etf, is_placeholder_name, limit_threshold, risk_warned
from ..functions.symbols import code as code_of
from ..functions.symbols import exchange as exchange_of
from ..functions.text import board_to_bk, event_type, keyword_sentiment, mentions, related_symbols, sector_name
from ..operators.adjust import with_hfq
from ..operators.asof import asof_step, expand_closed_open, expand_open, latest_snapshot, members_as_of
from ..operators.bars import previous_session, session_returns, tail
from ..operators.canonical import canonical, first_by
from ..operators.contains import overlapping

BREADTH = ("advance_count", "decline_count", "flat_count", "limit_up_count", "limit_down_count", "advance_ratio", "total_count")
LEVELS = ("L1", "L2", "L3")


def market_breadth(bars: DataFrame, sessions: DataFrame, status: DataFrame) -> DataFrame:
    """Seven metrics of each session in long form; needs a positive close on the previous calendar session."""
    warned = status.groupBy("symbol", "trade_date").agg(F.bool_or(risk_warned(F.col("status"), F.col("risk_warning"))).alias("warned"))
    both = previous_session(bars, sessions).where("prev_close > 0").join(warned, ["symbol", "trade_date"], "left")
    pct = (F.col("close") - F.col("prev_close")) / F.col("prev_close")
    return breadth_counts(both.select("trade_date", pct.alias("pct"), limit_threshold(F.col("symbol"), F.col("warned")).alias("limit")))


def breadth_counts(moves: DataFrame) -> DataFrame:
    """A5: the seven metrics of each day from its moves (trade_date, pct, limit), in long form."""
    n = lambda c: F.count_if(c).cast("double")
    wide = moves.groupBy("trade_date").agg(
        n(F.col("pct") > 0).alias("advance_count"), n(F.col("pct") < 0).alias("decline_count"), n(F.col("pct") == 0).alias("flat_count"),
        n(F.col("pct") >= F.col("limit")).alias("limit_up_count"), n(F.col("pct") <= -F.col("limit")).alias("limit_down_count"),
        (n(F.col("pct") > 0) / F.count("*")).alias("advance_ratio"), F.count("*").cast("double").alias("total_count"),
    )
    return wide.unpivot(["trade_date"], list(BREADTH), "metric_id", "value")


def industry_index(members: DataFrame, bars: DataFrame, factors: DataFrame, sessions: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Equal and amount-weighted returns of exact hfq bars per industry, level and day, every member group kept.

    Members are one row per snapshot and symbol (repeats collapse), so one pass over full codes gives sums that roll up to every level.
    """
    exact = with_hfq(bars, factors).where("adj_is_exact").withColumn("adj_close", F.col("close") * F.col("factor"))
    rets = session_returns(exact, sessions, "adj_close").select("symbol", "trade_date", "ret", safe_turnover(F.col("amount")).alias("amount"))
    snapshots = members.where("source = 'sw'").groupBy("as_of_date", "symbol").agg(F.min("industry_code").alias("industry_code"))
    roster = members_as_of(rets.select("trade_date"), "trade_date", snapshots).select("symbol", "trade_date", "industry_code")
    priced = roster.join(rets, ["symbol", "trade_date"], "left")
    have = F.col("ret").isNotNull()
    totals = {
        "n_members": F.count("*"), "n_priced": F.count("ret"), "ret_sum": F.sum("ret"), "weighted": F.sum(F.when(have, F.col("ret") * F.col("amount"))), "amount": F.sum(F.when(have, F.col("amount"))),
    }
    by_code = priced.groupBy("trade_date", F.col("industry_code").alias("full_code")).agg(*(v.alias(k) for k, v in totals.items()))
    level = F.inline(F.array(*(F.struct(F.lit(v).alias("level"), industry_level(F.col("full_code"), v).alias("industry_code")) for v in levels)))
    rolled = by_code.select("trade_date", *totals, level).groupBy("trade_date", "industry_code", "level").agg(*(F.sum(k).alias(k) for k in totals))
    grouped = rolled.withColumn("equal", F.try_divide("ret_sum", "n_priced")).withColumn("amount_weighted", F.try_divide("weighted", "amount"))
    keys = ["trade_date", "industry_code", "level", "n_members", "n_priced", "amount"]
    long = grouped.select(*keys, "equal", "amount_weighted").unpivot(keys, ["equal", "amount_weighted"], "weighting", "ret")
    return long.withColumn("n_excluded", F.col("n_members") - F.col("n_priced")).withColumn("weighting", F.replace("weighting", F.lit("amount_weighted"), F.lit("amount")))


def adj_factors(events: DataFrame, bars: DataFrame, adjust_type: str = "hfq") -> DataFrame:
    """D3: the step function of factor events on every bar date, 1.0 before the first."""
    steps = events.where(F.col("adjust_type") == adjust_type)
    out = asof_step(bars.select("symbol", "trade_date"), steps, "symbol", "trade_date", "ex_date", "factor", 1.0)
    return out.select("symbol", "trade_date", F.lit(adjust_type).alias("adjust_type"), "factor")


def symbols_to_refresh(bars: DataFrame, factors: DataFrame, actions: DataFrame, instruments: DataFrame, day) -> DataFrame:
    """Symbols whose whole factor history is due: uncovered ones, and those with an action or a listing on ``day``.

    Uncovered: no sound factor, the first one after the first traded bar, or fewer days than the bars once the factors reach the last bar
    (a missing tail is ordinary new data). Depositary receipts and what is neither stock nor fund have no factors.
    """
    real = bars.where(traded()).groupBy("symbol").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.countDistinct("trade_date").alias("n_bars"))
    sound = factors.where((F.col("adjust_type") == "hfq") & (F.col("factor") > 0) & (F.col("factor") < float("inf")))
    known = sound.groupBy("symbol").agg(F.min("trade_date").alias("first_factor"), F.max("trade_date").alias("last_factor"), F.countDistinct("trade_date").alias("n_factors"))
    hole = F.col("first_factor").isNull() | (F.col("first_factor") > F.col("first_bar")) | ((F.col("last_factor") >= F.col("last_bar")) & (F.col("n_factors") < F.col("n_bars")))
    priced = instruments.where(F.col("asset_type").isin("stock", "etf") & ~is_cdr(code_of(F.col("symbol")), exchange_of(F.col("symbol")))).select("symbol")
    uncovered = real.join(known, "symbol", "left").where(hole).join(priced, "symbol", "left_semi").select("symbol")
    acted = actions.where(F.col("ex_date") == F.lit(day).cast("date")).select("symbol")
    listed = instruments.where(F.col("list_date") == F.lit(day).cast("date")).select("symbol")
    return uncovered.unionByName(acted).unionByName(listed).distinct()


def bars_to_derive(bars: DataFrame, factors: DataFrame, refresh: DataFrame, watermark, lookback_days: int = 3) -> DataFrame:
    """The (symbol, date) pairs of one factor run: dates after the watermark, recent ones without a factor row, and all of refreshed symbols."""
    at = F.lit(watermark).cast("date")
    pairs = bars.select("symbol", "trade_date").distinct()
    new = pairs.where(F.col("trade_date") > at)
    recent = pairs.where(F.col("trade_date").between(F.date_sub(at, max(0, lookback_days - 1)), at) & ~is_cdr(code_of(F.col("symbol")), exchange_of(F.col("symbol"))))
    late = recent.join(factors.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
    return new.unionByName(late).unionByName(pairs.join(refresh, "symbol", "left_semi")).distinct()


def suspension_history(bars: DataFrame, sessions: DataFrame, instruments: DataFrame, start=None, end=None) -> DataFrame:
    """Sessions inside a symbol's life without a traded bar; funds and symbols that never traded are out.

    One pass over the bars: a symbol's traded days (at most one per calendar day) are held against the calendar, which is one small array.
    """
    days = F.when(traded(), F.col("trade_date"))
    seen = bars.groupBy("symbol").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.collect_set(days).alias("traded_days")).where(F.size("traded_days") > 0)
    life = seen.where(~is_etf(code_of(F.col("symbol")), exchange_of(F.col("symbol")))).join(instruments.select("symbol", "list_date", "delist_date"), "symbol")
    inside = sessions
    inside = inside.where(F.col("trade_date") >= F.lit(start)) if start is not None else inside
    inside = inside.where(F.col("trade_date") <= F.lit(end)) if end is not None else inside
    calendar = F.broadcast(inside.agg(F.collect_set("trade_date").alias("calendar")))
    lo, hi = F.greatest("list_date", "first_bar"), F.least("delist_date", "last_bar")
    missing = F.explode(F.array_except(F.filter("calendar", lambda d: d.between(lo, hi)), F.col("traded_days")))
    rows = life.crossJoin(calendar).select("symbol", missing.alias("trade_date"))
    return rows.select("symbol", "trade_date", F.lit(False).alias("is_trading"), F.lit("suspended").alias("status"), F.lit(None).cast("boolean").alias("risk_warning"))


def regulatory_events(announcements: DataFrame, keywords: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Announcements (one row per id) that carry a keyword, typed by the first one."""
    kw = (keywords,) if keywords else ()
    whole = canonical(announcements, ["announcement_id"]).where("title IS NOT NULL AND announcement_id IS NOT NULL AND symbol IS NOT NULL")
    hits = whole.where(mentions(F.col("title"), *kw)).select(
        F.concat(F.lit("reg-"), "announcement_id").alias("event_id"), "symbol", F.col("announce_date").alias("event_date"), event_type(F.col("title"), *kw).alias("event_type"), "title"
    )
    return first_by(hits, ["event_id"], [F.desc("event_date"), F.desc("symbol"), F.xxhash64("title").desc()])


def sentiment_scores(announcements: DataFrame, headlines: DataFrame, positive: dict[str, float] | None = None, negative: dict[str, float] | None = None) -> DataFrame:
    """Mean keyword score and number of headlines per symbol, day and channel; one row per announcement and headline."""
    announcements, headlines = canonical(announcements, ["announcement_id"]), canonical(headlines, ["news_id"])
    lexicon = () if positive is None else (positive, negative or {})
    score = lambda c: keyword_sentiment(F.col(c), *lexicon)
    a = announcements.select("symbol", F.col("announce_date").alias("trade_date"), F.lit("announcement").alias("score_channel"), score("title").alias("s"))
    h = headlines.select(F.explode(related_symbols(F.col("related_symbols"))).alias("symbol"), F.col("publish_date").alias("trade_date"), F.lit("news").alias("score_channel"), score("title").alias("s"))
    return a.unionByName(h).groupBy("symbol", "trade_date", "score_channel").agg(F.avg("s").alias("sentiment_score"), F.count("*").alias("headline_count"))


def delisting_events(bars: DataFrame) -> DataFrame:
    """How each price series ends, from its last 60 bars.

    Fixed values: window 60, halt gap 10 days, consolidation drop -25 %, decline -40 % below 2.0, at least 30 bars.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    last = tail(bars, 60).select("symbol", "trade_date", "close", F.datediff("trade_date", F.lag("trade_date").over(w)).alias("gap"), (F.try_divide("close", F.lag("close").over(w)) - 1).alias("r"))
    ends = last.groupBy("symbol").agg(
        F.max("gap").cast("long").alias("gap"), F.min("r").alias("worst"), F.max_by("close", "trade_date").alias("final"), F.min_by("close", "trade_date").alias("begin")
    )
    whole = bars.groupBy("symbol").agg(F.min("trade_date").alias("first_trade_date"), F.max("trade_date").alias("last_trade_date"), F.count("*").alias("bars"))
    enough = F.col("bars") >= 30
    window_return = F.try_divide("final", "begin") - 1
    pattern = (
        F.when(~enough, "insufficient").when((F.col("gap") > 10) & (F.col("worst") < -0.25), "consolidation")
        .when((window_return < -0.40) & (F.col("final") < 2.0), "abrupt_decline").otherwise("abrupt_stable")
    )
    known = lambda c, name: F.when(enough, c).alias(name)
    return whole.join(ends, "symbol").select(
        "symbol", "first_trade_date", "last_trade_date", pattern.alias("ending_pattern"), known(F.col("final"), "final_close"), known(F.col("gap"), "halt_gap_days"),
        known(F.col("worst"), "worst_final_return"), known(window_return, "final_window_return"), "bars",
    )


def industry_members_history(intervals: DataFrame, month_ends: DataFrame, least: int = 1000) -> DataFrame:
    """Membership at month ends; months with fewer than ``least`` members are dropped."""
    rows = expand_open(intervals, month_ends, "symbol", "start_date", "as_of_date")
    full = rows.groupBy("as_of_date").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") >= least)
    return rows.join(F.broadcast(full.select("as_of_date")), "as_of_date").select("symbol", "industry_code", "as_of_date")


def index_constituents_history(intervals: DataFrame, month_ends: DataFrame) -> DataFrame:
    """Constituents at month ends from half-open intervals."""
    return expand_closed_open(intervals, month_ends, "start_date", "end_date", "as_of_date").select("symbol", "industry_code", "as_of_date").distinct()


def merge_instruments(stored: DataFrame, incoming: DataFrame, formal: DataFrame | None = None) -> DataFrame:
    """Incoming rows win, missing symbols stay, known dates stick, formal delist dates override."""
    a, b = stored.alias("a"), incoming.alias("b")
    pick = lambda c: F.when(F.col("b.symbol").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    sticky = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    out = a.join(b, F.col("a.symbol") == F.col("b.symbol"), "full_outer").select(
        F.coalesce("b.symbol", "a.symbol").alias("symbol"), pick("name"), pick("exchange"), pick("asset_type"), sticky("list_date"), sticky("delist_date")
    )
    out = out.where(~is_placeholder_name(F.col("name")) | F.col("name").isNull())
    if formal is None:
        return out
    f = formal.select("symbol", F.col("delist_date").alias("_formal"))
    return out.join(f, "symbol", "left").withColumn("delist_date", F.coalesce("_formal", "delist_date")).drop("_formal")


def life_status(instruments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Delisted and not_listed rows for sessions outside each symbol's life."""
    days = F.broadcast(sessions.select("trade_date"))
    before = instruments.join(days, F.col("trade_date") < F.col("list_date")).select("symbol", "trade_date", F.lit("not_listed").alias("status"))
    after = instruments.join(days, F.col("trade_date") > F.col("delist_date")).select("symbol", "trade_date", F.lit("delisted").alias("status"))
    return before.unionByName(after).withColumn("is_trading", F.lit(False))


def calibrate_st(status: DataFrame, instruments: DataFrame) -> DataFrame:
    """An ST short name sets risk_warning; nothing clears it."""
    named = instruments.where(F.col("name").rlike(r"^\*?ST")).select("symbol", F.lit(True).alias("_st"))
    warned = F.when(F.coalesce("_st", F.lit(False)), F.lit(True)).otherwise(F.col("risk_warning"))
    return status.join(named, "symbol", "left").withColumn("risk_warning", warned).drop("_st")


def trading_calendar(bars: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every day between the first and last bar; sessions are weekdays that are no holiday."""
    span = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("trade_date"))
    off = holidays.select("trade_date", F.lit(True).alias("_off"))
    return days.join(F.broadcast(off), "trade_date", "left").select("trade_date", ((F.weekday("trade_date") < 5) & F.col("_off").isNull()).alias("is_trading"))


def sector_code_map(sectors: DataFrame, boards: DataFrame) -> DataFrame:
    """BK codes matched to board codes by number, names compared."""
    b = boards.select(board_to_bk(F.col("board_code")).alias("sector_code"), "board_code", F.col("board_name").alias("_name"))
    kind = F.when(F.col("board_code").isNull(), "unmatched").when(sector_name(F.col("sector_name")) == sector_name(F.col("_name")), "code_and_name").otherwise("code_only")
    return sectors.join(b, "sector_code", "left").select("sector_code", "sector_name", "board_code", kind.alias("match_type"))


def sector_routing(boards: DataFrame, indices: DataFrame, exclusive: str | None = None) -> DataFrame:
    """The source of each board's bars: exact normalised name, else the only fuzzy hit, else its own feed."""
    left = boards.select("sector_code", "sector_name", "board_type", sector_name(F.col("sector_name")).alias("k"))
    right = indices.select("tdx_code", sector_name(F.trim("name")).alias("k"))
    exact = right.groupBy("k").agg(F.countDistinct("tdx_code").alias("n_exact"), F.min("tdx_code").alias("exact_code"))
    # Names that normalise to nothing lie in every name; they are counted once, not paired with each board.
    n_empty, empty_code = right.where("k = ''").agg(F.countDistinct("tdx_code"), F.min("tdx_code")).first()
    pairs = overlapping(left.where(F.length("k") >= 2).select(F.col("k").alias("left")), right.select(F.col("k").alias("right")))
    others = right.join(right.where("k = ''").select("tdx_code").distinct(), "tdx_code", "left_anti")
    near = pairs.join(others, F.col("right") == F.col("k")).groupBy(F.col("left").alias("k")).agg(F.countDistinct("tdx_code").alias("n_near"), F.min("tdx_code").alias("near_code"))
    fuzzy = left.where(F.length("k") >= 2).select("k").distinct().join(near, "k", "left").select("k", (F.coalesce("n_near", F.lit(0)) + n_empty).alias("n_fuzzy"), F.least("near_code", F.lit(empty_code).cast("string")).alias("fuzzy_code"))
    joined = left.join(exact, "k", "left").join(fuzzy, "k", "left")
    own = F.col("sector_name").rlike(exclusive) if exclusive else F.lit(False)
    reason = (
        F.when(own, "em_exclusive").when((F.col("n_exact") == 1) & (F.col("board_type") == "industry"), "industry_exact").when(F.col("n_exact") == 1, "concept_exact")
        .when(F.col("n_exact") > 1, "exact_ambiguous").when(F.col("n_fuzzy") == 1, "fuzzy_unique").when(F.col("n_fuzzy") > 1, "fuzzy_ambiguous").otherwise("no_tdx_match")
    )
    out = joined.withColumn("reason", reason)
    r = F.col("reason")
    return out.select(
        "sector_code", "sector_name", "board_type", F.when(r.isin("industry_exact", "concept_exact", "fuzzy_unique"), "tdx").otherwise("em").alias("ohlc_source"),
        F.when(r.isin("industry_exact", "concept_exact"), F.col("exact_code")).when(r == "fuzzy_unique", F.col("fuzzy_code")).alias("tdx_code"),
        F.when(r == "industry_exact", "T1").when(r == "concept_exact", "T2").when(r == "fuzzy_unique", "T3").otherwise("T4").alias("routing_tier"), "reason",
    )


def purge_orphans(valuations: DataFrame, bars: DataFrame) -> DataFrame:
    """Valuation rows of symbols with a traded bar."""
    return valuations.join(bars.where(traded()).select("symbol").distinct(), "symbol", "left_semi")


def supplement_amount(stored: DataFrame, official: DataFrame) -> DataFrame:
    """Fills a missing amount only where official prices and volume equal the stored row."""
    keys = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
    side = official.select(*keys, F.col("amount").alias("_amount")).dropDuplicates(keys)
    return stored.join(side, keys, "left").withColumn("amount", F.coalesce("amount", "_amount")).drop("_amount").select(stored.columns)


def survivorship_gap(bars: DataFrame, instruments: DataFrame, years: Column | None = None) -> DataFrame:
    """Mean hold return per year over all symbols, over survivors, and the gap in points."""
    year = years if years is not None else F.year("trade_date")
    hold = bars.groupBy("symbol", year.alias("year")).agg((F.try_divide(F.max_by("close", "trade_date"), F.min_by("close", "trade_date")) - 1).alias("r"))
    rows = hold.join(instruments.select("symbol", "delist_date"), "symbol", "left")
    alive = F.col("delist_date").isNull()
    out = rows.groupBy("year").agg(F.count("*").alias("n_all"), F.count_if(alive).alias("n_survivors"), F.avg("r").alias("complete"), F.avg(F.when(alive, F.col("r"))).alias("survivors"))
    return out.withColumn("gap_pp", (F.col("survivors") - F.col("complete")) * 100)


def volume_to_shares(bars: DataFrame) -> DataFrame:
    """Rows of version v1 hold lots; they become v2 in shares."""
    old = F.col("data_version") == "v1"
    return bars.withColumn("volume", F.when(old, F.col("volume") * 100).otherwise(F.col("volume"))).withColumn("data_version", F.when(old, "v2").otherwise(F.col("data_version")))


def migrate_status(status: DataFrame) -> DataFrame:
    """ST moves from the status to risk_warning."""
    warned = risk_warned(F.col("status"), F.col("risk_warning"))
    return status.withColumn("risk_warning", warned).withColumn("status", F.when(F.col("status").isin(*LEGACY_ST), "normal").otherwise(F.col("status")))


def delisted_coverage(catalog: DataFrame, instruments: DataFrame, bars: DataFrame, start, end, recent: DataFrame | None = None) -> DataFrame:
    """Findings per symbol on how delisted names are covered in [start, end]; ``complete`` where there are none.

    ``catalog`` holds (symbol, last_traded) of names known to be gone, ``recent`` those of provisional probes. A last trade after the window leaves
    the overlap of a symbol without bars unknown. A formal date the day after the catalogue's last quote, with the last print at most three days
    before it, is a quote without a print and no mismatch.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    seen = bars.where(traded() & F.col("trade_date").between(lo, hi)).groupBy("symbol").agg(F.max("trade_date").alias("last_bar"))
    known = instruments.groupBy("symbol").agg(F.max("delist_date").alias("delist_date"), F.lit(True).alias("listed"))
    formal = F.col("delist_date").between(lo, hi)
    terminal = catalog.groupBy("symbol").agg(F.max("last_traded").alias("last_traded"))
    probe = recent.groupBy("symbol").agg(F.max("last_traded").alias("probed")) if recent is not None else terminal.select("symbol", F.lit(None).cast("date").alias("probed")).where("false")
    rows = terminal.join(known, "symbol", "full_outer").join(probe, "symbol", "full_outer").join(seen, "symbol", "left")
    listed, bare, last = F.coalesce("listed", F.lit(False)), F.col("last_bar").isNull(), F.col("last_traded")
    candidate = F.coalesce(last >= lo, F.lit(False))
    other = ~candidate & F.coalesce(formal, F.lit(False))
    definite = last <= hi
    off = definite & (F.col("last_bar") != last)
    quiet = (F.col("delist_date") == F.date_add(last, 1)) & F.datediff(last, F.col("last_bar")).between(1, 3)
    quiet = F.coalesce(quiet, F.lit(False))
    earlier = F.coalesce(last < lo, F.lit(False))
    fresh = F.col("probed").between(lo, hi) & ~F.coalesce(formal, F.lit(False)) & (~listed | bare)
    undated = lambda day: F.col("delist_date").isNull() | (F.col("delist_date") < day)
    overlap = candidate & (definite | ~bare)
    findings = {
        "missing_bars": candidate & bare & definite, "unknown_overlap": candidate & bare & ~definite, "terminal_nonprinting": candidate & off & quiet, "terminal_mismatch": candidate & off & ~quiet,
        "missing_instrument": overlap & ~listed, "invalid_delist_date": (overlap & listed & undated(last)) | (other & ~earlier & ~bare & undated(F.col("last_bar"))),
        "formal_no_overlap": other & earlier, "formal_unresolved": other & ~earlier & bare, "recent_quarantined": fresh,
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in findings.items())))
    finding = F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("complete"))))
    return rows.where(candidate | other | F.coalesce(F.col("probed").between(lo, hi), F.lit(False))).select("symbol", "last_traded", "delist_date", "last_bar", finding.alias("finding"))


def ownership(symbols: DataFrame, instruments: DataFrame, bars: DataFrame, status: DataFrame, sessions: DataFrame, start, end, evidence: DataFrame | None = None) -> DataFrame:
    """Who answers for a symbol's bars in [start, end], from explicit evidence only.

    not_listed, delisted_before_window, non_trading (a status of every session says so) and negative_evidence (a live record covers the window) expect no
    data; delegated_delisted goes to the recovery of delisted names (funds do not); placeholder is an undated stock or fund that never traded; generic must have
    bars; anything else is unknown. Several status rows of a day: trading if one says so. Trading evidence beats negative evidence.
    """
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    window = sessions.where(F.col("trade_date").between(s, e)).select("trade_date").distinct()
    daily = status.groupBy("symbol", "trade_date").agg(F.max("is_trading").alias("is_trading"))
    inside = daily.join(F.broadcast(window.withColumn("_in", F.lit(True))), "trade_date", "left")
    said = inside.groupBy("symbol").agg(
        F.count("_in").alias("n_covered"), F.count_if(F.col("_in") & ~F.col("is_trading")).alias("n_closed"), F.bool_or(F.col("_in") & F.col("is_trading")).alias("positive")
    )
    calendar = F.broadcast(window.agg(F.count("*").alias("n_sessions")))
    ever = bars.where(traded()).select("symbol").distinct().withColumn("ever", F.lit(True))
    covering = (evidence if evidence is not None else symbols.select("symbol", s.alias("start_date"), e.alias("end_date")).where("false")).where((F.col("start_date") <= s) & (F.col("end_date") >= e))
    master = instruments.select("symbol", "list_date", "delist_date", "asset_type", F.lit(True).alias("known"))
    rows = symbols.select("symbol").distinct().join(master, "symbol", "left").join(said, "symbol", "left").join(ever, "symbol", "left")
    rows = rows.join(covering.select("symbol", F.lit(True).alias("negative")).distinct(), "symbol", "left").crossJoin(calendar)
    positive, negative = F.coalesce("positive", F.lit(False)), F.coalesce("negative", F.lit(False))
    asked = F.col("n_covered").isNotNull() & (F.col("n_sessions") > 0)
    phantom = F.col("asset_type").isin("stock", "etf") & F.col("list_date").isNull() & F.col("ever").isNull()
    fund = is_etf(code_of(F.col("symbol")), exchange_of(F.col("symbol")))
    plain = F.when(F.col("asset_type").isNull(), "unknown").when(negative & ~positive, "negative_evidence").when(phantom, "placeholder").otherwise("generic")
    why = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("list_date") > e, "not_listed").when(F.col("delist_date") < s, "delisted_before_window")
        .when((F.col("delist_date") <= e) & ~fund, "delegated_delisted").when(F.col("delist_date") <= e, F.when(negative & ~positive, "negative_evidence").otherwise("generic"))
        .when(asked & (F.col("n_closed") == F.col("n_sessions")), "non_trading").when(asked & ~positive, "unknown").otherwise(plain)
    )
    return rows.select("symbol", why.alias("ownership"))


def statement_items(reports: DataFrame, items: list[str], announced: DataFrame) -> DataFrame:
    """Wide reports to one row per item, dated by the authoritative notice or the report's own."""
    long = reports.unpivot(["symbol", "report_period", "notice_date"], items, "item_code", "item_value").where("item_value IS NOT NULL")
    first = announced.groupBy("symbol", "report_period").agg(F.min("announce_date").alias("_d"))
    return long.join(first, ["symbol", "report_period"], "left").withColumn("announce_date", F.coalesce("_d", "notice_date")).drop("_d", "notice_date")


# The wording of landed plans per ten shares.
PLAN_PART = r"(?:10\s*股?\s*)?(送|转增?|派|配)\s*([0-9]+(?:\.[0-9]+)?)"
PLAN_PRICE = r"配股(?:价|价格)\s*([0-9]+(?:\.[0-9]+)?)\s*元?"
PLAN_WORDS = {"cash_dividend": ("派",), "bonus": ("送",), "transfer": ("转", "转增"), "allotment": ("配",)}
DONE = "实施方案"


def _per_action(amounts: dict[str, Column], price: Column) -> Column:
    """One struct per action with a positive amount per share; only allotments carry a price."""
    rows = (F.struct(F.lit(k).alias("action_type"), v.alias("per_share"), (price if k == "allotment" else F.lit(None).cast("double")).alias("allotment_price")) for k, v in amounts.items())
    return F.filter(F.array(*rows), lambda x: x["per_share"] > 0)


def plan_actions(plans: DataFrame) -> DataFrame:
    """Finished plans as text (``plan``, ``progress``) to one row per action; amounts of one kind add up, and a text without numbers gives no row."""
    words, values = (F.regexp_extract_all("plan", F.lit(PLAN_PART), F.lit(i)) for i in (1, 2))
    parts = F.transform(F.arrays_zip(words.alias("word"), values.alias("value")), lambda x: F.struct(x["word"].alias("word"), (x["value"].cast("double") / 10).alias("value")))
    rows = plans.where(F.col("progress").startswith(DONE) & F.col("ex_date").isNotNull()).withColumn("_parts", parts)
    of = lambda words: F.aggregate(F.filter("_parts", lambda x: x["word"].isin(*words)), F.lit(0.0), lambda acc, x: acc + x["value"])
    price = F.nullif(F.expr(f"try_cast(regexp_extract(plan, r'{PLAN_PRICE}', 1) AS DOUBLE)"), F.lit(0.0))
    return rows.select("symbol", "ex_date", F.inline(_per_action({k: of(w) for k, w in PLAN_WORDS.items()}, price)))


def _numeric_plan(plans: DataFrame) -> DataFrame:
    """Per-share amounts; a combined share ratio counts where neither part is given, as a transfer if the text names only that."""
    share = lambda c: F.coalesce(c, F.lit(0.0)) / 10
    text = F.lower(F.coalesce("plan_text", F.lit("")))
    split = (share(F.col("bonus_per_10")) != 0) | (share(F.col("transfer_per_10")) != 0)
    combined = F.when(split, 0.0).otherwise(share(F.col("combined_per_10")))
    moved = text.contains("转") & ~text.contains("送")
    return plans.select(
        "*", text.alias("_text"), combined.alias("_combined"), share(F.col("cash_per_10")).alias("_cash"), F.when((combined > 0) & ~moved, combined).otherwise(share(F.col("bonus_per_10"))).alias("_bonus"),
        F.when((combined > 0) & moved, combined).otherwise(share(F.col("transfer_per_10"))).alias("_transfer"),
    )


def action_rows(plans: DataFrame) -> DataFrame:
    """Landed plans per ten shares in columns to one row per action and share."""
    amounts = {"cash_dividend": F.col("_cash"), "bonus": F.col("_bonus"), "transfer": F.col("_transfer")}
    return _numeric_plan(plans).select("symbol", "ex_date", F.inline(_per_action(amounts, F.lit(None).cast("double")))).drop("allotment_price")


def unreadable_plans(plans: DataFrame) -> DataFrame:
    """Plans whose text names an action that has no number at all; a batch that holds any is refused."""
    named = lambda *words: reduce(lambda a, b: a | b, (F.col("_text").contains(w) for w in words))
    no_shares = F.col("combined_per_10").isNull() & (F.col("_combined") <= 0)
    lost = (
        ((F.col("_cash") <= 0) & named("派", "息", "现金") & F.col("cash_per_10").isNull()) | ((F.col("_bonus") <= 0) & named("送") & F.col("bonus_per_10").isNull() & no_shares)
        | ((F.col("_transfer") <= 0) & named("转") & F.col("transfer_per_10").isNull() & no_shares)
    )
    return _numeric_plan(plans).where(lost & F.col("ex_date").isNotNull()).select(plans.columns)


def market_value(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Close times the latest positive share count dated by the day; free float from amount and turnover in percent where both are positive."""
    points = shares.where("total_shares > 0")
    out = asof_step(bars.select("symbol", "trade_date", "close", "amount", "turnover_pct"), points, "symbol", "trade_date", "change_date", "total_shares")
    floating = F.when((F.col("amount") > 0) & (F.col("turnover_pct") > 0), F.col("amount") / (F.col("turnover_pct") / 100))
    return out.withColumn("total_mv", F.col("close") * F.col("total_shares")).withColumn("float_mv", floating)


def macro_series(raw: DataFrame) -> DataFrame:
    """Month labels become month ends, values that are no finite numbers are dropped."""
    value = F.expr("try_cast(value AS DOUBLE)")
    rows = raw.select("indicator_id", F.last_day(F.to_date(F.concat("month", F.lit("-01")))).alias("obs_date"), value.alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def backfill_plan(instruments: DataFrame, bar_spans: DataFrame, start) -> DataFrame:
    """Symbols whose bars begin after they should, and from which day to fetch."""
    plan = instruments.where("asset_type = 'stock'").join(bar_spans, "symbol", "left").withColumn("fetch_start", F.greatest("list_date", F.lit(start).cast("date")))
    return plan.where(F.col("first_bar").isNull() | (F.col("first_bar") > F.col("fetch_start"))).select("symbol", "fetch_start")


def complete_dates(df: DataFrame, day: str, counted: str, least: int) -> DataFrame:
    """Dates with at least so many distinct members."""
    return df.groupBy(day).agg(F.countDistinct(counted).alias("n")).where(F.col("n") >= least)


def capture_scope(members: DataFrame, day: str = "as_of_date") -> DataFrame:
    """The symbols of the latest roster."""
    return latest_snapshot(members, day).select("symbol").distinct()


def retired_names(bars: DataFrame, instruments: DataFrame, catalog: DataFrame | None = None, quiet_days: int = 180, placeholders: int = 20) -> DataFrame:
    """Instrument spans of retired stocks: catalogue names, and symbols silent long before the lake ends.

    A silent symbol with a delist date is known already; one with a run of at least ``placeholders`` later dates without a trade is halted, not gone.
    The delist date is the later of the catalogue's and the last traded bar; a name without bars has no list date.
    """
    real = bars.where(traded()).groupBy("symbol").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"))
    end = bars.agg(F.max("trade_date").alias("lake_end"))
    quiet = real.crossJoin(F.broadcast(end)).where(F.datediff("lake_end", "last_bar") > quiet_days)
    quiet = quiet.join(instruments.where("delist_date IS NOT NULL").select("symbol"), "symbol", "left_anti")
    after = bars.join(quiet.select("symbol", "last_bar"), "symbol").where("trade_date > last_bar")
    halted = after.groupBy("symbol").agg(F.countDistinct("trade_date").alias("n")).where(F.col("n") >= placeholders)
    silent = quiet.join(halted, "symbol", "left_anti").select("symbol", F.lit(None).cast("date").alias("last_traded"))
    named = catalog.select("symbol", "last_traded") if catalog is not None else silent.where("false")
    targets = named.unionByName(silent).groupBy("symbol").agg(F.max("last_traded").alias("last_traded"))
    equity = ~is_etf(code_of(F.col("symbol")), exchange_of(F.col("symbol")))
    return targets.where(equity).join(real, "symbol", "left").select("symbol", F.col("first_bar").alias("list_date"), F.greatest("last_traded", "last_bar").alias("delist_date"))


def retract_derived(status: DataFrame, certified: DataFrame) -> DataFrame:
    """Drops derived_delisted rows whose symbol is not certified as delisted by that day."""
    dates = certified.select("symbol", F.col("delist_date").alias("_d"))
    keep = (F.col("source") != "derived_delisted") | (F.col("trade_date") > F.col("_d"))
    return status.join(dates, "symbol", "left").where(F.coalesce(keep, F.lit(False))).drop("_d")


def status_presence(live: DataFrame, instruments: DataFrame, days: DataFrame) -> DataFrame:
    """Per day, the listed symbols that the live snapshot lacks and the rows that nobody asked for."""
    asked = instruments.select("symbol", "list_date", "delist_date").join(F.broadcast(days.select("trade_date").distinct()), _alive()).select("symbol", "trade_date", F.lit(1).alias("asked"))
    got = live.select("symbol", "trade_date").where("symbol IS NOT NULL").withColumn("got", F.lit(1))
    both = asked.unionByName(got, allowMissingColumns=True).groupBy("symbol", "trade_date").agg(F.count("asked").alias("asked"), F.count("got").alias("got"))
    return both.groupBy("trade_date").agg(F.sum(F.when(F.col("got") == 0, F.col("asked")).otherwise(0)).alias("n_missing"), F.count_if(F.col("asked") == 0).alias("n_unexpected"))


def dealt(instruments: DataFrame, days: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Instruments in so many partitions that each, crossed with ``days``, makes about ``rows`` rows; they are few themselves, and would be one task's."""
    return instruments.repartition(instruments.count() * days.count() // rows + 1, "symbol")


def _alive() -> Column:
    listed = F.col("list_date").isNull() | (F.col("list_date") <= F.col("trade_date"))
    return listed & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("trade_date")))


def assemble_status(live: DataFrame, history: DataFrame, instruments: DataFrame, days: DataFrame, max_age: int = 5) -> DataFrame:
    """Each day's snapshot of the listed symbols, and derived rows of delisted and not yet listed ones.

    A day whose live snapshot is incomplete (a symbol missing or unexpected) takes the last stored snapshot of the ``max_age`` days before it, marked
    ``eastmoney_cached``; symbols that it lacks are suspended with an unknown warning. A day with neither has no live rows: ``status_presence`` tells.
    """
    wanted = F.broadcast(days.select("trade_date").distinct())
    whole = status_presence(live, instruments, days).where("n_missing = 0 AND n_unexpected = 0").select("trade_date")
    out = ["symbol", "trade_date", "is_trading", "status", "risk_warning"]
    fresh = live.join(F.broadcast(whole), "trade_date", "left_semi").select(*out, F.lit("eastmoney").alias("source"))
    broken = wanted.join(whole, "trade_date", "left_anti")
    stored = history.select(F.col("trade_date").alias("stored")).distinct()
    near = (F.col("stored") < F.col("trade_date")) & (F.datediff("trade_date", "stored") <= max_age)
    pick = broken.join(F.broadcast(stored), near).groupBy("trade_date").agg(F.max("stored").alias("stored"))
    last = history.select("symbol", F.col("trade_date").alias("stored"), "is_trading", "status", "risk_warning", F.lit(True).alias("_known"))
    asked = instruments.select("symbol", "list_date", "delist_date").join(F.broadcast(pick), _alive()).select("symbol", "trade_date", "stored")
    held = asked.join(last, ["symbol", "stored"], "left")
    known = F.col("_known").isNotNull()
    cached = held.select(
        "symbol", "trade_date", F.coalesce(F.col("is_trading") & known, F.lit(False)).alias("is_trading"), F.when(known, F.col("status")).otherwise("suspended").alias("status"), "risk_warning",
        F.lit("eastmoney_cached").alias("source"),
    )
    gone = instruments.join(wanted, F.col("delist_date") <= F.col("trade_date")).select("symbol", "trade_date", F.lit("delisted").alias("status"), F.lit("derived_delisted").alias("source"))
    not_yet = (F.col("list_date") > F.col("trade_date")) & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("trade_date")))
    early = instruments.join(wanted, not_yet).select("symbol", "trade_date", F.lit("not_listed").alias("status"), F.lit("derived_not_listed").alias("source"))
    derived = gone.unionByName(early).withColumn("is_trading", F.lit(False)).withColumn("risk_warning", F.lit(None).cast("boolean"))
    return fresh.unionByName(cached).unionByName(derived)


def fill_gaps(primary: DataFrame, backup: DataFrame, expected: DataFrame) -> DataFrame:
    """Backup rows only for expected keys that the primary lacks."""
    missing = expected.select("symbol", "trade_date").join(primary.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
    return primary.unionByName(backup.join(missing, ["symbol", "trade_date"], "left_semi"), allowMissingColumns=True)


def union_holders(total: DataFrame, floating: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the total scope borrow the announce date of the float scope; undated rows go."""
    dates = floating.groupBy("symbol", "record_date").agg(F.max("announce_date").alias("_d"))
    dated = total.join(dates, ["symbol", "record_date"], "left").withColumn("announce_date", F.coalesce("announce_date", "_d")).drop("_d")
    return first_by(dated.unionByName(floating).where("announce_date IS NOT NULL"), key, [F.desc("announce_date")])


def enrich_list_dates(instruments: DataFrame, side: DataFrame) -> DataFrame:
    """A side table fills missing list dates."""
    s = side.groupBy("symbol").agg(F.min("list_date").alias("_d"))
    return instruments.join(s, "symbol", "left").withColumn("list_date", F.coalesce("list_date", "_d")).drop("_d")


def symbol_priority(hot_rank: DataFrame, announcements: DataFrame, bars: DataFrame, day, limit: int) -> DataFrame:
    """The ``limit`` symbols to score on a day: hot ranks of the latest snapshot by then, those with announcements, then traded bars by amount.

    Within announcements the symbol decides, as nothing else orders them; a symbol counts in the first list that names it.
    """
    d = F.lit(day).cast("date")
    hot = latest_snapshot(hot_rank.where(F.col("trade_date") <= d), "trade_date").select("symbol", F.lit(0).alias("priority"), F.col("rank").cast("double").alias("place"))
    told = announcements.where(F.col("announce_date") == d).select("symbol", F.lit(1).alias("priority"), F.lit(0.0).alias("place"))
    moved = bars.where(traded() & (F.col("trade_date") == d)).select("symbol", F.lit(2).alias("priority"), (-F.col("amount")).alias("place"))
    first = F.min(F.struct("priority", F.coalesce("place", F.lit(float("inf"))).alias("place"))).alias("best")
    best = hot.unionByName(told).unionByName(moved).where("symbol IS NOT NULL").groupBy("symbol").agg(first)
    return best.select("symbol", "best.priority", "best.place").orderBy("priority", "place", "symbol").limit(limit)


def replace_covered(stored: DataFrame, fresh: DataFrame, day: str) -> DataFrame:
    """Recomputed dates replace stored ones, others stay."""
    return stored.join(F.broadcast(fresh.select(day).distinct()), day, "left_anti").unionByName(fresh)


def yearly_acceptance(bars: DataFrame) -> DataFrame:
    """Rows, symbols and days per year."""
    return bars.groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("trade_date").alias("n_days"))


def spot_check(bars: DataFrame, factors: DataFrame, picks: DataFrame) -> DataFrame:
    """Adjusted closes of picked (symbol, trade_date) pairs: by backward factors where any are stored, else by forward ones; 1 where a pair has none."""
    kinds = F.broadcast(factors.agg(F.bool_or(F.col("adjust_type") == "hfq").alias("_hfq"), F.bool_or(F.col("adjust_type") == "qfq").alias("_qfq")))
    kind = F.when(F.col("_hfq"), "hfq").when(F.col("_qfq"), "qfq")
    typed = factors.crossJoin(kinds).where(F.col("adjust_type") == kind).select("symbol", "trade_date", "factor")
    rows = bars.join(picks.select("symbol", "trade_date").distinct(), ["symbol", "trade_date"], "left_semi").join(typed, ["symbol", "trade_date"], "left").crossJoin(kinds)
    return rows.select("symbol", "trade_date", "close", (F.col("close") * F.coalesce("factor", F.lit(1.0))).alias("adj_close"), kind.alias("adjust_type"))


def split_by_source(symbols: DataFrame) -> DataFrame:
    """Which source serves a symbol."""
    return symbols.withColumn("served_by", F.when(exchange_of(F.col("symbol")).isin("SH", "SZ"), "primary").otherwise("fallback"))


def recovered_instruments(instruments: DataFrame, delisted: DataFrame, bar_spans: DataFrame) -> DataFrame:
    """Adds recovered delisted names that the instruments lack, dated by their bars; known names get a missing delist date."""
    b = bar_spans.select("symbol", "first_bar", "last_bar")
    new = delisted.join(instruments.select("symbol"), "symbol", "left_anti").join(b, "symbol", "left")
    new = new.select("symbol", "name", F.col("first_bar").alias("list_date"), F.coalesce("delist_date", "last_bar").alias("delist_date"))
    known = instruments.join(delisted.select("symbol", F.col("delist_date").alias("_d")), "symbol", "left")
    return known.select("symbol", "name", "list_date", F.coalesce("delist_date", "_d").alias("delist_date")).unionByName(new)


def announcement_window(announcements: DataFrame, days: DataFrame, start, end) -> DataFrame:
    """The window clamped to the indexed span, and how many of its days have no announcements (a hole refuses the run)."""
    have = announcements.select("announce_date").distinct()
    span = have.agg(F.greatest(F.min("announce_date"), F.lit(start).cast("date")).alias("lo"), F.least(F.max("announce_date"), F.lit(end).cast("date")).alias("hi"))
    inside = days.join(F.broadcast(span), F.col("trade_date").between(F.col("lo"), F.col("hi")))
    holes = inside.join(have, F.col("trade_date") == F.col("announce_date"), "left_anti")
    return span.crossJoin(holes.agg(F.count("*").alias("n_holes")))
