"""Survivorship-safe universes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import excluded, in_universe, listed_on


class UniverseCoverageError(ValueError):
    """A strict universe lacks status rows for requested pairs."""


@dataclass(frozen=True)
class Profile:
    name: str
    universe: str
    strict: bool
    version: int = 1
    legacy: bool = False


PROFILES = (
    Profile("research_all_a", "all_a", True),
    Profile("research_sh_sz", "all_a_sh_sz", True),
    Profile("legacy_all_a", "all_a", False, legacy=True),
    Profile("legacy_sh_sz", "all_a_sh_sz", False, legacy=True),
)


def listed(bars: DataFrame, instruments: DataFrame, universe: str = "all_a", day: str = "trade_date") -> DataFrame:
    """Rows of whitelisted symbols on days inside their listing."""
    span = instruments.select("symbol", F.col("list_date").alias("_list"), F.col("delist_date").alias("_delist"))
    joined = bars.where(in_universe(F.col("symbol"), universe)).join(span, "symbol")
    return joined.where(listed_on(F.col(day), F.col("_list"), F.col("_delist"))).drop("_list", "_delist")


def apply_universe(bars: DataFrame, instruments: DataFrame, status: DataFrame, universe: str = "all_a", strict: bool = False) -> DataFrame:
    """Listed rows less those of an excluded status; strict demands a status for every pair."""
    inside = listed(bars, instruments, universe)
    if strict and (n := uncovered(inside, status).count()):
        raise UniverseCoverageError(f"{n} (symbol, date) pairs have no status")
    out = status.where(excluded(F.col("status"), F.col("risk_warning"))).select("symbol", "trade_date")
    return inside.join(out, ["symbol", "trade_date"], "left_anti")


def uncovered(bars: DataFrame, status: DataFrame) -> DataFrame:
    return bars.select("symbol", "trade_date").distinct().join(status.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")


def tradable_on(instruments: DataFrame, status: DataFrame, day, universe: str = "all_a") -> DataFrame:
    """Symbols of the universe listed and not excluded on one day."""
    d = F.lit(day).cast("date")
    alive = instruments.where(in_universe(F.col("symbol"), universe) & listed_on(d, F.col("list_date"), F.col("delist_date"))).select("symbol")
    out = status.where((F.col("trade_date") == d) & excluded(F.col("status"), F.col("risk_warning"))).select("symbol")
    return alive.join(out, "symbol", "left_anti")


def ever_traded(bars: DataFrame) -> DataFrame:
    """Rows of symbols that traded at least once."""
    return bars.join(bars.where("volume > 0 OR volume IS NULL").select("symbol").distinct(), "symbol", "left_semi")


def scope_hash(symbols: DataFrame) -> DataFrame:
    """Number and hash of a scope, free of order: per-symbol digests summed over 38 digits, so that no list is gathered."""
    part = F.conv(F.substring(F.md5("symbol"), 1, 15), 16, 10).cast("decimal(38,0)")
    return symbols.select("symbol").distinct().agg(F.count("*").alias("n_symbols"), F.sum(part).cast("string").alias("scope_hash"))
