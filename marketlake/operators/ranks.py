"""Exact order statistics per group at any size (A11): rank selection by narrowing brackets.

A sketch gives pivots around the wanted rank; one aggregation counts exactly what lies below, on and between two neighbouring pivots and sketches what is between
them. The bracket shrinks by about ``GRID`` a round, ties of a pivot settle at once, and what is left (``FEW`` values at most) is sorted. No group is held in one place, and a
group of any size is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID, ACCURACY, FEW = 128, 2_000, 10_000


def _pivots(value: Column) -> Column:
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _bracket(requests: DataFrame) -> DataFrame:
    """Neighbouring pivots around rank ``at`` of ``inside`` values; the sketch's error of one in ``ACCURACY`` is allowed for on both sides."""
    share, slack = F.col("at") / F.col("inside"), 2.0 / ACCURACY
    low = F.greatest(F.floor((share - slack) * GRID), F.lit(0)).cast("int")
    high = F.least(F.ceil((share + slack) * GRID), F.lit(GRID)).cast("int")
    # The outermost pivots are the least and greatest value.
    return requests.withColumn("a", F.when(low == 0, F.col("lo")).otherwise(F.col("pivots")[low])).withColumn("b", F.when(high == GRID, F.col("hi")).otherwise(F.col("pivots")[high]))


def kth_values(df: DataFrame, group: str, value: str, ranks: Callable[[Column], Column], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The values of the given ranks (from 1; ``ranks`` maps a group's count of non-null values to an array) as (group, n, rank, value).

    ``keep`` writes a small table and returns it read back (one row per group and rank), so that rounds do not stack.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    first = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _pivots(F.col("v")).alias("pivots"))
    open_ = first.select("g", "n", F.explode(ranks(F.col("n"))).alias("rank"), "lo", "hi", "pivots")
    open_ = keep(_bracket(open_.withColumn("inside", F.col("n")).withColumn("at", F.col("rank"))).select("g", "n", "rank", "a", "b"), "ranks")
    found = []
    while True:
        asked = open_.select(F.col("g").alias("q"), "n", "rank", "a", "b")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        between = (v > a) & (v < b)
        inner = F.when(between, v)
        met = rows.join(asked, F.col("g").eqNullSafe(F.col("q"))).groupBy("g", "n", "rank", "a", "b").agg(
            F.count_if(v < a).alias("below"), F.count_if(v == a).alias("on_a"), F.count_if(between).alias("inside"), F.count_if((v == b) & (b > a)).alias("on_b"),
            F.min(inner).alias("lo"), F.max(inner).alias("hi"), _pivots(inner).alias("pivots"),
        )
        at = F.col("rank") - F.col("below") - F.col("on_a")
        met = keep(met.withColumn("at", at), "ranks")
        # The rank lies on one of the pivots or between them, as the brackets allow for the sketch's error; a bracket that missed starts again from its outer side.
        settled = F.when((F.col("at") <= 0) & (F.col("at") > -F.col("on_a")), a).when((F.col("at") > F.col("inside")) & (F.col("at") <= F.col("inside") + F.col("on_b")), b)
        done = met.withColumn("value", settled)
        found.append(done.where("value IS NOT NULL").select("g", "n", "rank", "value"))
        todo = done.where("value IS NULL")
        missed = todo.where("at <= 0 OR at > inside + on_b")
        few = todo.where(f"at BETWEEN 1 AND inside AND inside <= {FEW}").select(F.col("g").alias("q"), "n", "rank", "a", "b", "at")
        last = rows.join(few, F.col("g").eqNullSafe(F.col("q"))).where(between).groupBy("g", "n", "rank", "at").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        found.append(last.select("g", "n", "rank", F.element_at("vs", F.col("at").cast("int")).alias("value")))
        more = _bracket(todo.where(f"at BETWEEN 1 AND inside AND inside > {FEW}")).select("g", "n", "rank", "a", "b")
        wider = missed.join(first.select(F.col("g").alias("q"), F.col("lo").alias("l"), F.col("hi").alias("h")), F.col("g").eqNullSafe(F.col("q"))).select(
            "g", "n", "rank", F.when(F.col("at") <= 0, F.col("l")).otherwise(F.col("b")).alias("a"), F.when(F.col("at") <= 0, F.col("a")).otherwise(F.col("h")).alias("b")
        )
        open_ = keep(more.unionByName(wider), "ranks")
        if open_.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return keep(out.select(F.col("g").alias(group), "n", "rank", "value"), "ranks")


def grouped_median(df: DataFrame, group: str, value: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(group, n, median) of the non-null values: the middle value, or the mean of both middle ones. A group without values has no row."""
    middle = lambda n: F.array_distinct(F.array(F.floor((n + 1) / 2).cast("long"), (F.floor(n / 2) + 1).cast("long")))
    two = kth_values(df, group, value, middle, keep)
    return two.groupBy(group, "n").agg(F.avg("value").alias("median"))
