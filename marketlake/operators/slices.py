"""Ordered work on hot keys: windows over time slices with a carried boundary.

A window over a symbol is one task, whatever the symbol's size. Here each (key, slice) is a group of its own: a slice is any value that grows with
time (a year of bars, an hour of ticks). Rows see their own slice; what they need of earlier ones is one row per (key, slice), combined on
the map side, carried forward by a window over slices, and joined back on the same (key, slice), so that the rows are dealt once.

Results equal those of the plain window. Defined results: rows without key or time stay and find nothing; events without key, time or value count
for nothing; of several events of one time the greatest value holds; rows of one time are ordered by ``ties``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours(at: str) -> Column:
    """A slice per hour of a timestamp."""
    return F.date_trunc("hour", F.col(at))


def years(day: str) -> Column:
    """A slice per year of a date."""
    return F.year(day)


def _carried(ends: DataFrame, key: list[str], values: list[str], nulls: bool) -> DataFrame:
    """Per (key, slice), the values of the nearest earlier slice that has a row (of non-null values, where ``nulls`` is false)."""
    before = Window.partitionBy(*key).orderBy("_slice")
    if nulls:
        carry = [F.lag(v).over(before).alias(f"_carried_{v}") for v in values]
    else:
        carry = [F.last(v, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carried_{v}") for v in values]
    return ends.select(*key, "_slice", *carry)


def asof(left: DataFrame, events: DataFrame, key: str, on: str, start: str, value: str, by, default=None) -> DataFrame:
    """Adds the value of the latest event at or before ``on`` per key; ``by`` maps a time column's name to its slice."""
    marked = left.select("*", F.lit(1).alias("_kind"), F.col(on).alias("_at"), F.lit(None).cast(events.schema[value].dataType).alias("_value"))
    steps = events.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(value).isNotNull())
    steps = steps.select(F.col(key), F.lit(0).alias("_kind"), F.col(start).cast(left.schema[on].dataType).alias("_at"), F.col(value).alias("_value"))
    both = marked.unionByName(steps, allowMissingColumns=True).withColumn("_slice", by("_at"))
    group = Window.partitionBy(key, "_slice")
    here = F.last("_value", ignorenulls=True).over(group.orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(key, "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).alias("_end"))
    carry = _carried(ends, [key], ["_end"], nulls=False)
    found = both.withColumn("_here", here).where("_kind = 1").join(carry, [key, "_slice"], "left")
    known = F.when(F.col(key).isNotNull() & F.col("_at").isNotNull(), F.coalesce("_here", "_carried__end"))
    out = found.withColumn(value, known).select(*left.columns, value)
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def previous(rows: DataFrame, key: list[str], at: str, by, columns: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns of the row before (new name to column), over slices; null on the first row of a key and where key or time is null."""
    order = [at, *ties]
    sliced = rows.withColumn("_slice", by(at))
    w = Window.partitionBy(*key, "_slice").orderBy(*order)
    sources = list(dict.fromkeys(columns.values()))
    ends = sliced.where(F.col(at).isNotNull()).groupBy(*key, "_slice").agg(F.max_by(F.struct(*sources), F.struct(*order)).alias("_end"))
    carry = _carried(ends, key, ["_end"], nulls=True)
    local = sliced.select("*", F.row_number().over(w).alias("_n"), *(F.lag(c).over(w).alias(f"_before_{c}") for c in sources))
    joined = local.join(carry, [*key, "_slice"], "left")
    known = F.col(at).isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    pick = lambda c: F.when(known, F.when(F.col("_n") > 1, F.col(f"_before_{c}")).otherwise(F.col("_carried__end")[c]))
    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *(pick(c).alias(new) for new, c in columns.items()))


def running_sum(rows: DataFrame, key: list[str], at: str, by, value: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the key up to each row."""
    sliced = rows.withColumn("_slice", by(at))
    totals = sliced.groupBy(*key, "_slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*key, "_slice", F.sum("_sum").over(earlier).alias("_carried"))
    w = Window.partitionBy(*key, "_slice").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.withColumn("_here", F.sum(value).over(w)).join(carry, [*key, "_slice"], "left")
    total = F.when(F.col("_here").isNotNull() | F.col("_carried").isNotNull(), F.coalesce("_here", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return joined.select(*(c for c in rows.columns if c != name), total.alias(name))


def first_of_key(rows: DataFrame, key: list[str], at: str, value: str, name: str) -> DataFrame:
    """Adds the value of the key's first row: one row per key, combined on the map side and joined back (Spark splits a hot key of that join)."""
    first = rows.where(F.col(at).isNotNull()).groupBy(*key).agg(F.min_by(value, at).alias(name))
    return rows.join(first, key, "left")
