"""As-of and interval joins (J7-J12, J18-J20, S19), always with an equi key or a small broadcast calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_intervals(events: DataFrame, key: str, start: str, until: str = "until") -> DataFrame:
    """A step function's events as half-open intervals: each ends where the next of its key starts."""
    return events.withColumn(until, F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def asof_step(left: DataFrame, events: DataFrame, key: str, on: str, start: str, value: str, default=None) -> DataFrame:
    """Adds the value of the latest event at or before ``on`` per key.

    Both sides meet in one sorted pass per key (union and last non-null), so neither is broadcast and no row pairs are made.
    """
    marked = left.select("*", F.lit(1).alias("_kind"), F.col(on).alias("_at"), F.lit(None).cast(events.schema[value].dataType).alias("_value"))
    steps = events.select(F.col(key), F.lit(0).alias("_kind"), F.col(start).alias("_at"), F.col(value).alias("_value"))
    both = marked.unionByName(steps, allowMissingColumns=True)
    window = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(value, F.last("_value", ignorenulls=True).over(window)).where("_kind = 1").drop("_kind", "_at", "_value")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))


def snapshot_of_day(days: DataFrame, day: str, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Each day with the latest snapshot date at or before it; both lists are calendar-sized."""
    dates = F.broadcast(snapshots.select(as_of).distinct())
    return days.select(day).distinct().join(dates, F.col(as_of) <= F.col(day)).groupBy(day).agg(F.max(as_of).alias(as_of))


def members_as_of(days: DataFrame, day: str, members: DataFrame, as_of: str = "as_of_date") -> DataFrame:
    """The roster that holds on each day: its latest snapshot's rows."""
    return members.join(F.broadcast(snapshot_of_day(days, day, members, as_of)), as_of)


def expand_open(intervals: DataFrame, dates: DataFrame, key: str, start: str, as_of: str) -> DataFrame:
    """Per date and key, the row with the latest start at or before the date."""
    ended = to_intervals(intervals, key, start, "_until")
    hit = (F.col(start) <= F.col(as_of)) & (F.col("_until").isNull() | (F.col(as_of) < F.col("_until")))
    return ended.join(F.broadcast(dates.select(as_of).distinct()), hit).drop("_until")


def expand_closed_open(intervals: DataFrame, dates: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Rows whose interval start <= date < end holds on each date; a null end is open."""
    hit = (F.col(start) <= F.col(as_of)) & (F.col(end).isNull() | (F.col(as_of) < F.col(end)))
    return intervals.join(F.broadcast(dates.select(as_of).distinct()), hit)


def expected_sessions(spans: DataFrame, sessions: DataFrame, first: str, last: str, day: str = "trade_date") -> DataFrame:
    """Every (key, session) inside each key's span: a range join with the broadcast calendar."""
    return spans.join(F.broadcast(sessions.select(day)), F.col(day).between(F.col(first), F.col(last)))


def with_neighbours(sessions: DataFrame, day: str = "trade_date") -> DataFrame:
    """Each session with the one before and after; the calendar is a few thousand rows."""
    w = Window.orderBy(day)
    return sessions.select(day, F.lag(day).over(w).alias("prev_date"), F.lead(day).over(w).alias("next_date"))


def window_with_previous(df: DataFrame, day: str, start, end) -> DataFrame:
    """Rows in [start, end] and the latest day's strictly before start."""
    before = df.where(F.col(day) < F.lit(start)).agg(F.max(day).alias("_last"))
    earlier = df.join(F.broadcast(before), F.col(day) == F.col("_last"), "left_semi")
    return df.where(F.col(day).between(F.lit(start), F.lit(end))).unionByName(earlier)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def latest_snapshot(df: DataFrame, day: str) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max(day).alias("_last"))), F.col(day) == F.col("_last"), "left_semi")
