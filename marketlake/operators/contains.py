"""Substring joins by a gram index (J21, D17): pairs of texts of which one contains the other, without comparing all with all.

Each text that may be contained is looked up by its rarest gram only (two characters; one where the text has one), and the few texts that hold this gram are checked whole. A text
with a gram that no other holds is dropped before any pair is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Distinct (inner, outer) where the text ``outer`` contains the non-empty text ``inner``; each frame has the one column of its name."""
    found = None
    for n in (1, 2):
        length = F.length("inner")
        texts = inner.where(length == 1 if n == 1 else length >= 2).distinct()
        index = outer.distinct().select("outer", F.explode(grams(F.col("outer"), n)).alias("gram"))
        sizes = index.groupBy("gram").agg(F.count("*").alias("n_outer"))
        mine = texts.select("inner", F.size(grams(F.col("inner"), n)).alias("n_grams"), F.explode(grams(F.col("inner"), n)).alias("gram"))
        held = mine.join(sizes, "gram").groupBy("inner", "n_grams").agg(F.count("*").alias("n_held"), F.min_by("gram", F.struct("n_outer", "gram")).alias("gram"))
        pairs = held.where("n_held = n_grams").join(index, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (left, right) of non-empty texts of which one contains the other, equal ones included; each frame has the one column of its name."""
    forward = contained(left.select(F.col("left").alias("inner")), right.select(F.col("right").alias("outer"))).select(F.col("inner").alias("left"), F.col("outer").alias("right"))
    back = contained(right.select(F.col("right").alias("inner")), left.select(F.col("left").alias("outer"))).select(F.col("outer").alias("left"), F.col("inner").alias("right"))
    return forward.unionByName(back).distinct()
