"""Structured Streaming forms of the bar jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.market import in_tick_session
from ..operators.canonical import first_by
from ..sources.lake import compact, delete, exists


def tick_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars from a tick stream, emitted once the watermark passes their window."""
    return (
        ticks.withWatermark("trade_time", late)
        .groupBy("symbol", F.window("trade_time", f"{minutes} minutes"))
        .agg(
            F.min_by("price", F.struct("trade_time", "tick_seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", F.struct("trade_time", "tick_seq")).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
        )
        .select("symbol", F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", "volume", "n_ticks")
    )


def first_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (symbol, date, sequence) once."""
    return ticks.withWatermark("trade_time", late).dropDuplicatesWithinWatermark(["symbol", "trade_date", "tick_seq"])


def session_checks(ticks: DataFrame) -> DataFrame:
    """Running counts per symbol and day: ticks, off-session ticks, sequence bounds."""
    return ticks.groupBy("symbol", "trade_date").agg(
        F.count("*").alias("n"), F.count_if(~in_tick_session(F.col("trade_time"))).alias("n_off"), F.min("tick_seq").alias("lo"), F.max("tick_seq").alias("hi")
    )


def upsert_stream(bars: DataFrame, root: str, checkpoint: str, key: list[str], day: str, granularity: str) -> StreamingQuery:
    """Merges each micro-batch into the lake; a replayed batch changes nothing."""
    merge: Callable[[DataFrame, int], None] = lambda batch, _: compact(batch.sparkSession, batch, root, key, day, granularity) and None
    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DayChecks(StatefulProcessor):
    """State of one (symbol, day): counts, and the sequence numbers seen as ranges. A timer at the end of the day emits the findings and drops the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, n_off long, n_repeated long")
        self.ranges = handle.getValueState("ranges", "bounds array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, n_off, n_repeated = self.totals.get() if self.totals.exists() else (0, 0, 0)
        bounds = list(self.ranges.get()[0]) if self.ranges.exists() else []
        if not bounds:
            self.handle.registerTimer(day_end(key[1]))
        for part in rows:
            bounds, repeated = with_numbers(bounds, part["tick_seq"].to_numpy())
            n, n_off, n_repeated = n + len(part), n_off + int(part["off_session"].sum()), n_repeated + repeated
        self.totals.update((int(n), int(n_off), int(n_repeated)))
        self.ranges.update((bounds,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (n, n_off, n_repeated), bounds = self.totals.get(), self.ranges.get()[0]
        lo, hi = bounds[0], bounds[-1]
        missing = hi - lo + 1 - sum(b - a + 1 for a, b in zip(bounds[::2], bounds[1::2]))
        self.totals.clear()
        self.ranges.clear()
        yield pd.DataFrame({"symbol": [key[0]], "trade_date": [key[1]], "n": [n], "n_off": [n_off], "n_repeated": [n_repeated], "lo": [lo], "hi": [hi], "n_missing": [missing]})

    def close(self) -> None:
        pass


def day_end(day: date) -> int:
    """Milliseconds of the end of a day; times are those of the session's zone, UTC."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000) + 86_400_000


def with_numbers(bounds: list[int], numbers: np.ndarray) -> tuple[list[int], int]:
    """Ranges (first, last, first, last, ...) with more numbers in them, and how many of these had been seen before."""
    numbers = np.sort(numbers.astype(np.int64))
    fresh = np.unique(numbers)
    edges = np.array(bounds, np.int64)
    # A number lies in a range if an odd number of range edges stands before it.
    inside = (np.searchsorted(edges[::2], fresh, side="right") - np.searchsorted(edges[1::2], fresh, side="left")) > 0
    fresh = fresh[~inside]
    repeated = len(numbers) - len(fresh)
    firsts, lasts = np.concatenate((edges[::2], fresh)), np.concatenate((edges[1::2], fresh))
    order = np.argsort(firsts, kind="stable")
    firsts, lasts = firsts[order], lasts[order]
    starts = np.flatnonzero(np.concatenate(([True], firsts[1:] != lasts[:-1] + 1))) if len(firsts) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(firsts)) - 1
    return [int(x) for pair in zip(firsts[starts], lasts[stops]) for x in pair], repeated


def session_findings(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """X4 with bounded state: one row per symbol and day, once the watermark passes the day's end; that state is gone then.

    ``n`` ticks, those off session, repeated numbers, the least and greatest number and how many are missing between. A tick without symbol, date, time or number is
    left out. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    whole = ticks.where("symbol IS NOT NULL AND trade_date IS NOT NULL AND trade_time IS NOT NULL AND tick_seq IS NOT NULL")
    marked = whole.withWatermark("trade_time", late).select("symbol", "trade_date", "trade_time", "tick_seq", (~in_tick_session(F.col("trade_time"))).alias("off_session"))
    out = "symbol string, trade_date date, n long, n_off long, n_repeated long, lo long, hi long, n_missing long"
    return marked.groupBy("symbol", "trade_date").transformWithStateInPandas(DayChecks(), out, "Append", "EventTime")


def _bar_of(ticks: DataFrame, minutes: int) -> DataFrame:
    return ticks.withColumn("bar_start", F.window("trade_time", f"{minutes} minutes").start)


def revise_bars(batch: DataFrame, number: int, root: str, minutes: int) -> None:
    """X2 with corrections: lands a batch of ticks and builds anew, from all landed ticks, the bars it touches, however late its ticks are.

    Ticks lie under ``root/ticks`` by day and batch (a replay overwrites its own), bars under ``root/bars`` by day, and ``root/revisions`` tells per batch which bars are
    new and which were replaced. A tick that comes again with another price replaces the earlier one. Only the touched days are read.
    """
    spark = batch.sparkSession
    dynamic = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    dynamic(batch.withColumn("batch", F.lit(number).cast("long")), "trade_date", "batch").parquet(f"{root}/ticks")
    landed = spark.read.schema(batch.schema.add("batch", "long")).parquet(f"{root}/ticks")
    arrived = _bar_of(landed.where(F.col("batch") == number), minutes)
    touched = arrived.select("symbol", "trade_date", "bar_start").distinct()
    days = F.broadcast(touched.select("trade_date").distinct())
    key = ["symbol", "trade_date", "bar_start"]
    of_days = landed.where(F.col("batch") <= number).join(days, "trade_date", "left_semi")
    last = first_by(of_days, ["symbol", "trade_date", "tick_seq"], [F.desc("batch"), F.desc("trade_time"), F.desc("price"), F.desc("volume")])
    at = F.struct("trade_time", "tick_seq")
    built = _bar_of(last, minutes).join(touched, key, "left_semi").groupBy(*key).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    )
    there = exists(spark, f"{root}/bars")
    old = spark.read.schema(built.schema).parquet(f"{root}/bars") if there else built.where("false")
    old = old.join(days, "trade_date", "left_semi")
    aside = f"{root}/aside_{number}_{uuid.uuid4().hex}"
    before = old.select(*key, F.lit(True).alias("replaced"))
    built.join(before, key, "left").withColumn("replaced", F.coalesce("replaced", F.lit(False))).write.parquet(f"{aside}/built")
    built = spark.read.parquet(f"{aside}/built")
    # A replay finds its own bars in the table, so what was written of it first stays.
    if not exists(spark, f"{root}/revisions/batch={number}/_SUCCESS"):
        built.select(*key, "replaced").write.mode("overwrite").parquet(f"{root}/revisions/batch={number}")
    old.join(built.select(*key), key, "left_anti").unionByName(built.drop("replaced")).write.parquet(f"{aside}/whole")
    dynamic(spark.read.parquet(f"{aside}/whole").repartition("trade_date"), "trade_date").parquet(f"{root}/bars")
    delete(spark, aside)


def correcting_bars(ticks: DataFrame, root: str, checkpoint: str, minutes: int) -> StreamingQuery:
    """A stream of ticks into bars that late ticks correct."""
    revise: Callable[[DataFrame, int], None] = lambda batch, number: batch.isEmpty() or revise_bars(batch, number, root, minutes)
    return ticks.writeStream.foreachBatch(revise).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
