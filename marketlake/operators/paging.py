"""Pages, latest rows and searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

PROVENANCE = ("source", "data_version", "fetched_at")


def keyset_page(df: DataFrame, key: str | list[str], cursor, limit: int) -> DataFrame:
    """The next rows after ``cursor`` in key order, and one more to tell whether others follow (TakeOrdered, no full sort).

    A key of several columns has a cursor of as many values, so that rows that tie with the cursor in the first of them are not skipped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if cursor is None:
        return df.orderBy(*keys).limit(limit + 1)
    values = [cursor] if isinstance(key, str) else list(cursor)
    after, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, values, strict=True):
        bound = F.lit(v).cast(df.schema[k].dataType)
        after = after | (equal & (F.col(k) > bound))
        equal = equal & (F.col(k) == bound)
    # The first column's bound by itself can be pushed to the files.
    first = F.col(keys[0]) >= F.lit(values[0]).cast(df.schema[keys[0]].dataType)
    return df.where(first & after).orderBy(*keys).limit(limit + 1)


@dataclass(frozen=True)
class Page:
    """Rows of a page, the number of rows of the whole result, and whether rows were left out after it."""

    rows: DataFrame
    total: int
    truncated: bool


def page_with_total(df: DataFrame, limit: int, offset: int = 0, order: list[str] | None = None) -> Page:
    """A page and the honest total from one run: rows are counted as they pass, and each task keeps at most offset + limit of them.

    Without an order the page has the first rows in the order in which the plan's partitions come. A page is small: it passes through the driver.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    # The whole input passes in either case: an order needs it, and the row's place stands in where there is none.
    ordered = counted.orderBy(*order) if order else counted.withColumn("_place", F.monotonically_increasing_id()).orderBy("_place").drop("_place")
    rows = ordered.offset(offset).limit(limit).collect()
    total = int(seen.get["n"])
    return Page(df.sparkSession.createDataFrame(rows, df.schema), total, offset + limit < total)


def offset_page(df: DataFrame, order: list[str], limit: int, offset: int = 0, provenance: bool = False) -> tuple[DataFrame, int, bool]:
    """A page, the honest total, and whether rows were left out; one run gives both."""
    page = page_with_total(df, limit, offset, order)
    return (page.rows if provenance else page.rows.drop(*PROVENANCE)), page.total, page.truncated


def latest_per(df: DataFrame, key: str, day: str) -> DataFrame:
    """The latest row of each key by day, then fetch time."""
    order = F.struct(*(c for c in (day, "fetched_at") if c in df.columns))
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("_r")).select(key, "_r.*")


def most_traded(bars: DataFrame, day, n: int) -> DataFrame:
    return bars.where(F.col("trade_date") == F.lit(day)).orderBy(F.desc("amount"), "symbol").limit(n)


def search_instruments(instruments: DataFrame, text: str | None = None, exchange: str | None = None, asset_type: str | None = None, as_of=None, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    out = instruments
    if text:
        out = out.where(F.contains(F.lower("symbol"), F.lit(text.lower())) | F.contains(F.lower("name"), F.lit(text.lower())))
    out = out.where(F.col("exchange") == exchange) if exchange else out
    out = out.where(F.col("asset_type") == asset_type) if asset_type else out
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        out = out.where((F.col("list_date").isNull() | (F.col("list_date") <= day)) & (F.col("delist_date").isNull() | (F.col("delist_date") >= day)))
    return out if limit is None else keyset_page(out, "symbol", cursor, limit)


def resolve_symbol(instruments: DataFrame, query: str) -> DataFrame:
    """Code prefix or name fragment; live names rank before delisted ones."""
    hit = F.col("symbol").startswith(query.upper()) | F.contains(F.lower("name"), F.lit(query.lower()))
    return instruments.where(hit).select("symbol", "name", F.col("delist_date").isNotNull().alias("is_delisted"))
