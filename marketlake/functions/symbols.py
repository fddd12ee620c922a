"""Symbol, universe and status expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes by exchange, reserved bands, statuses and sources.
PREFIXES = {"SH": ("60", "68"), "SZ": ("00", "30"), "BJ": ("92", "43", "83", "87")}
RESERVED = tuple(str(p) for p in range(81, 90))
CDR = ("689",)
ETF = {"SH": ("51", "52", "56", "58"), "SZ": ("15", "16")}
PLACEHOLDER_NAMES = ("认购款", "申购款")
EXCLUDED_STATUSES = ("suspended", "delisted", "not_listed", "st", "*st")
LEGACY_ST = ("st", "*st")
SNAPSHOT_SOURCES = ("eastmoney", "tdx_protocol")
UNIVERSES = ("all_a", "all_a_sh_sz")


def code(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", 1)


def exchange(symbol: Column) -> Column:
    return F.upper(F.substring_index(symbol, ".", -1))


def format_symbol(code_: Column, exchange_: Column) -> Column:
    return F.concat_ws(".", code_, F.upper(exchange_))


def starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, (c.startswith(p) for p in prefixes))


def infer_exchange(raw: Column) -> Column:
    c = F.lpad(F.trim(raw.cast("string")), 6, "0")
    return F.when(starts(c, PREFIXES["SH"]), "SH").when(starts(c, PREFIXES["BJ"]), "BJ").otherwise("SZ")


def normalize_market(code_: Column, market: Column) -> Column:
    m = F.lower(market)
    ex = F.when(m.isin("sh", "1"), "SH").when(m.isin("sz", "0"), "SZ").when(m.isin("bj", "2"), "BJ").otherwise(F.upper(market))
    return F.struct(F.lpad(code_, 6, "0").alias("code"), ex.alias("exchange"))


def _six_digits(c: Column) -> Column:
    return c.rlike("^[0-9]{6}$")


def _any_exchange(c: Column, ex: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return reduce(or_, ((ex == e) & starts(c, p) for e, p in table.items()))


def is_all_a(code_: Column, exchange_: Column) -> Column:
    ex = F.upper(exchange_)
    reserved = ex.isin("SH", "SZ") & starts(code_, RESERVED)
    return F.coalesce(_six_digits(code_) & ~reserved & _any_exchange(code_, ex, PREFIXES), F.lit(False))


def is_cdr(code_: Column, exchange_: Column) -> Column:
    return F.coalesce(_six_digits(code_) & (F.upper(exchange_) == "SH") & starts(code_, CDR), F.lit(False))


def is_etf(code_: Column, exchange_: Column) -> Column:
    # One pattern: a filter that is pushed below the place where symbols are made evaluates them once for each mention.
    kinds = (f"(?:{'|'.join(p)})[0-9]{{4}}\\.{e}" for e, p in ETF.items())
    return F.coalesce(F.concat(code_, F.lit("."), F.upper(exchange_)).rlike(f"^(?:{'|'.join(kinds)})\\z"), F.lit(False))


def in_universe(symbol: Column, universe: str = "all_a") -> Column:
    """Whitelisted prefixes less reserved bands, depositary receipts and funds; one pattern, as in ``is_etf``."""
    if universe not in UNIVERSES:
        raise ValueError(f"unsupported universe: {universe!r}")
    out = {"SH": (*RESERVED, *CDR, *ETF["SH"]), "SZ": (*RESERVED, *ETF["SZ"])}
    allowed = (f"{_none_of(out.get(e, ()))}(?:{'|'.join(p)}).*\\.(?i:{e})" for e, p in PREFIXES.items() if universe == "all_a" or e in ("SH", "SZ"))
    return symbol.rlike(f"(?s)^(?:{'|'.join(allowed)})\\z")


def _none_of(prefixes: tuple[str, ...]) -> str:
    return f"(?!{'|'.join(prefixes)})" if prefixes else ""


def listed_on(day: Column, list_date: Column, delist_date: Column) -> Column:
    """Both ends inclusive; a null bound is open."""
    return (list_date.isNull() | (list_date <= day)) & (delist_date.isNull() | (day <= delist_date))


def risk_warned(status: Column, risk_warning: Column) -> Column:
    return F.coalesce(risk_warning, F.lit(False)) | F.coalesce(status.isin(*LEGACY_ST), F.lit(False))


def excluded(status: Column, risk_warning: Column) -> Column:
    return F.coalesce(status.isin(*EXCLUDED_STATUSES), F.lit(False)) | risk_warned(status, risk_warning)


def not_trading(status: Column, is_trading: Column) -> Column:
    return F.coalesce(status.isin("suspended", "delisted", "not_listed"), F.lit(False)) | ~F.coalesce(is_trading, F.lit(False))


def is_placeholder_name(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(name), "\\x{0}+$", ""))
    return F.coalesce(reduce(or_, (bare.endswith(n) for n in PLACEHOLDER_NAMES)), F.lit(False))


def source_rank(source: Column, primary: str | None, backup: str | None) -> Column:
    rank = F.lit(0)
    if backup:
        rank = F.when(source == backup, 1).otherwise(rank)
    if primary:
        rank = F.when(source == primary, 2).otherwise(rank)
    return rank


def evidence_rank(source: Column, fetched_at: Column, trade_date: Column) -> Column:
    """2 for an observation of the session, 1 for a derived row, 0 for a later restatement; the clock is UTC+8."""
    local = fetched_at + F.expr("INTERVAL '8' HOUR")
    same = F.coalesce((local.cast("date") == trade_date) & (F.hour(local) >= 15), F.lit(False))
    snapshot = F.coalesce(source.isin(*SNAPSHOT_SOURCES), F.lit(False))
    return (
        F.when(source == "eastmoney_cached", 0).when(snapshot & same, 2).when(snapshot, 0).when(source == "derived_bar_gap", 1).otherwise(2)
    )


def limit_threshold(symbol: Column, risk_warning: Column) -> Column:
    c = code(symbol)
    return (
        F.when(F.coalesce(risk_warning, F.lit(False)), 0.045).when(exchange(symbol) == "BJ", 0.295)
        .when(c.startswith("30") | c.startswith("688"), 0.195).otherwise(0.095)
    )
