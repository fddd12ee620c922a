"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import traded
from ..functions.symbols import evidence_rank, source_rank
from .digest import PROVENANCE, aggregates, business_columns


def canonical(df: DataFrame, key: list[str], primary: str | None = None, backup: str | None = None, evidence: bool = False) -> DataFrame:
    """The row of each key with the best evidence, then latest fetch, source rank, source and version; a row hash breaks ties."""
    order = [evidence_rank(F.col("source"), F.col("fetched_at"), F.col("trade_date")).desc()] if evidence else []
    order += [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in df.columns else []
    if "source" in df.columns:
        order += [source_rank(F.col("source"), primary, backup).desc(), F.col("source").desc_nulls_last()]
    order += [F.col("data_version").desc_nulls_last()] if "data_version" in df.columns else []
    return first_by(df, key, [*order, F.xxhash64(*df.columns).desc()])


def first_by(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes before the shuffle (window group limit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def traded_rows(df: DataFrame, key: list[str], **sources) -> DataFrame:
    """Canonical first, then rows that traded (a null volume counts as traded)."""
    return canonical(df, key, **sources).where(traded())


def latest_vintage(df: DataFrame, key: list[str]) -> DataFrame:
    """The last announced, then observed, then fetched version of each fact."""
    kept = [k for k in key if k != "announce_date"]
    order = [F.col(c).desc_nulls_last() for c in ("announce_date", "observed_at", "fetched_at", "data_version") if c in df.columns]
    return first_by(df, kept, [*order, F.xxhash64(*df.columns).desc()])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def business_digest(df: DataFrame, provenance: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """Row count and order-free, additive digest of the columns that carry business content."""
    return df.agg(*aggregates(business_columns(df, provenance)))


def stratified_sample(df: DataFrame, stratum: str, key: list[str], slots: int) -> DataFrame:
    """A fixed number of rows per stratum, the first by hash of the key: the same rows on each run."""
    return first_by(df, [stratum], [F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))), *key], slots)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], **sources) -> DataFrame:
    return canonical(existing.unionByName(incoming, allowMissingColumns=True), key, **sources)
