"""Point-in-time reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import quarter_label
from .canonical import latest_vintage


def classify(df: DataFrame, as_of, mode: str = "best_effort", legacy_cutoff: bool = False) -> DataFrame:
    """Rows visible at ``as_of``, flagged pit_is_exact and pit_quality; strict keeps exact ones only."""
    if mode not in ("strict", "best_effort"):
        raise ValueError(f"unsupported mode {mode!r}")
    cut = F.lit(as_of).cast("date")
    day = lambda c: F.col(c).cast("date") if c in df.columns else F.lit(None).cast("date")
    known_by = lambda c: day(c).isNull() | (day(c) <= cut)
    visible = F.coalesce(day("announce_date") <= cut, F.lit(False)) & known_by("available_at") & known_by("source_published_at")
    seen = F.greatest(day("observed_at"), day("fetched_at"))
    in_time = F.coalesce(seen <= cut, F.lit(False))
    rebuilt = F.lower(F.coalesce(F.col("source"), F.lit(""))).rlike("backfill|reconstruct|snapshot") if "source" in df.columns else F.lit(False)
    exact = visible & ~rebuilt & in_time
    chosen = exact if mode == "strict" else visible & in_time if legacy_cutoff else visible
    return df.where(chosen).select("*", exact.alias("pit_is_exact"), F.when(exact, "strict").otherwise("reconstructed").alias("pit_quality"))


def read_pit(df: DataFrame, key: list[str], as_of, items: list[str] | None = None, all_vintages: bool = False, start=None, end=None, **mode) -> DataFrame:
    """Classified facts, filtered by item, collapsed to the latest vintage and cut to report periods start..end."""
    out = classify(df, as_of, **mode)
    out = out.where(F.col("item_code").isin(*items)) if items else out
    out = out if all_vintages else latest_vintage(out, key)
    out = out.where(F.col("report_period") >= quarter_label(F.lit(start).cast("date"))) if start is not None else out
    return out.where(F.col("report_period") <= quarter_label(F.lit(end).cast("date"))) if end is not None else out
