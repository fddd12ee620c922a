"""Operator 6, mixing sources to target weights by the cube method.

A source's target over its size gives each of its documents some whole copies and a fractional inclusion probability.
The flight phase takes three documents at a time and moves their probabilities along the null space of the two
constraints (word total, document total) until one is 0 or 1, so both totals stay exact. It runs in groups of at
most about ``GROUP`` documents of one source, dealt by hash, so a hot source is many groups; what each group
leaves undecided (two documents at most) meets in the next level, until each source is one small group. Landing then rounds the last
two so that the word total is off least, and exchanges a few documents of that group if this brings it nearer.

Only per-source totals (one row per source) reach the driver. Moves are drawn from generators seeded by source, level and group:
reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words has target 0;
rows that repeat are drawn one by one; extra columns are left out.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

WEIGHTS, SHARE, MOST, GROUP = (3, 1, 2), 1.5, 2, 4096
#: Sources up to this number are sent to all tasks; more are joined.
BROADCAST_SOURCES = 50_000
_UNIT = "source string, doc_id long, th long, size long, again long, source_size long, target double, whole long, p double, picked int"


def water_fill(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Targets by weight, in code point order with null last; no target above ``most`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    active = list(names)
    while active:
        unit = left / sum(weight[s] for s in active)
        over = [s for s in active if unit * weight[s] > most * sizes[s]]
        for s in over or active:
            target[s] = float(most * sizes[s]) if over else unit * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        active = [s for s in active if s not in set(over)]
    return target


def _flight(p: list[float], size: list[int], draw: random.Random) -> list[int]:
    """Moves ``p`` in place; returns the places that stay fractional."""
    pool: list[int] = []
    for i in [*range(len(p)), None]:
        if i is not None:
            pool.append(i)
            if len(pool) < 3:
                continue
        while len(pool) >= (3 if i is not None else 2):
            if len(pool) == 2:
                if size[pool[0]] != size[pool[1]]:
                    break
                u = [1.0, -1.0]
            else:
                a, b, c = (size[j] for j in pool)
                u = [float(b - c), float(c - a), float(a - b)] if not a == b == c else [1.0, -1.0, 0.0]
            up = min((1 - p[j]) / v if v > 0 else p[j] / -v for j, v in zip(pool, u) if v)
            down = min(p[j] / v if v > 0 else (1 - p[j]) / -v for j, v in zip(pool, u) if v)
            step = up if draw.random() * (up + down) < down else -down
            for j, v in zip(pool, u):
                q = p[j] + step * v
                p[j] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            pool = [j for j in pool if 0 < p[j] < 1]
    return pool


def _land(left: list[int], p: list[float], size: list[int]) -> None:
    """Rounds the last documents so that words, then documents, are off least."""
    best = None
    for bits in range(1 << len(left)):
        pick = [bits >> i & 1 for i in range(len(left))]
        off = (abs(sum((x - p[j]) * size[j] for x, j in zip(pick, left))), abs(sum(x - p[j] for x, j in zip(pick, left))), bits)
        best = min(best or (off, pick), (off, pick))
    for j, x in zip(left, best[1] if best else []):
        p[j] = float(x)


def _polish(p: list[float], size: list[int], goal: float, swaps: int = 6) -> None:
    """Exchanges a taken document for one left out while that brings the word total nearer to its goal."""
    for _ in range(swaps):
        off = sum(x * n for x, n in zip(p, size)) - goal
        taken, out = (np.array([j for j, x in enumerate(p) if x == v], int) for v in (1.0, 0.0))
        if abs(off) < 1 or not len(taken) or not len(out):
            return
        n = np.array(size)
        out = out[np.argsort(n[out], kind="stable")]
        at = np.clip(np.searchsorted(n[out], n[taken] - off) + np.array([[-1], [0]]), 0, len(out) - 1)
        left = np.abs(off - n[taken] + n[out][at])
        row, col = np.unravel_index(left.argmin(), left.shape)
        if left[row, col] >= abs(off):
            return
        p[taken[col]], p[out[at[row, col]]] = 0.0, 1.0


def _fly(level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "th", "again"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].tolist(), pdf["size"].tolist()
        goal = sum(x * n for x, n in zip(p, size))
        left = _flight(p, size, random.Random(f"{key[0]}|{key[1]}|{level}"))
        if pdf["groups"].iloc[0] == 1:
            _land(left, p, size)
            _polish(p, size, goal)
        pdf["p"] = p
        pdf["picked"] = pd.array([int(x) if x in (0.0, 1.0) else None for x in p], dtype="Int32")
        return pdf[["source", "doc_id", "th", "size", "again", "source_size", "target", "whole", "p", "picked"]]

    return run


def numbered_repeats(sized: DataFrame) -> DataFrame:
    """Each row, with ``again`` numbering equal rows from 0, so that many repeats of one row are dealt to many groups.

    Equal rows are counted on the map side and unfolded again, in runs of at most 1000.
    """
    counted = sized.groupBy("source", "doc_id", "th", "size").agg(F.count("*").alias("n"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) DIV 1000"))).alias("run"))
    return runs.select("source", "doc_id", "th", "size", F.explode(F.sequence(F.col("run") * 1000, F.least(F.col("n"), (F.col("run") + 1) * 1000) - 1)).alias("again"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, mark: Column | None = None) -> DataFrame:
    """source, doc_id, th (the mark, else a hash of the text), size, source_size, target, copies of each row."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), (F.xxhash64("text") if mark is None else mark).alias("th"), words.alias("size")), "sizes")
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goals = water_fill(totals, weights, share, most)
    rows = []
    for s, n in totals.items():
        f = goals[s] / n if n else 0.0
        whole = math.floor(f + 1e-12)
        rows.append((s, n, goals[s], whole, max(0.0, f - whole) if f - whole > 1e-12 else 0.0))
    plan = spark.createDataFrame(rows, "_source string, source_size long, target double, whole long, p double")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan
    units = numbered_repeats(sized).join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    settled = (F.col("p") == 0) | (F.col("size") == 0)
    done = [units.where(settled).withColumn("picked", F.lit(0))]
    open_units, level = units.where(~settled), 0
    while True:
        groups = open_units.groupBy("source").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
        counted = {r["source"]: r["groups"] for r in groups.collect()}
        if not counted:
            break
        known = spark.createDataFrame(list(counted.items()), "_source string, groups int")
        known = F.broadcast(known) if len(counted) <= BROADCAST_SOURCES else known
        dealt = open_units.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        dealt = dealt.withColumn("group", F.expr("CAST(pmod(IF(again = 0, xxhash64(doc_id, th, size), xxhash64(doc_id, th, size, again)), groups) AS INT)"))
        flown = materialize(dealt.groupBy("source", "group").applyInPandas(_fly(level), _UNIT), "flown")
        done.append(flown.where("picked IS NOT NULL"))
        open_units, level = flown.where("picked IS NULL").drop("picked"), level + 1
        if max(counted.values()) == 1:
            break
    columns = ["source", "doc_id", "th", "size", "source_size", "target", (F.col("whole") + F.col("picked")).alias("copies")]
    return reduce(DataFrame.unionByName, (d.select(*columns) for d in done))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document appears as often as the mix takes it.

    Defined results: rows that differ in any column are mixed apart, equal ones appear as often as all of them are taken; a null text has no words and stays as often as its source's whole copies say;
    a null source is one of its own; extra columns stay, whatever their names; an empty table gives no rows.
    """
    # Maps have no hash: their text stands for them.
    told = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no"), F.coalesce("source", F.lit("\0")).alias("_source")]
    same = ["_id", "_no", "_source", "_th"]
    copies = mix(docs, mark=told).select(*key, F.col("th").alias("_th"), "copies").groupBy(*same).agg(F.sum("copies").alias("_copies"))
    keyed = docs.select(F.struct("*").alias("row"), *key, told.alias("_th"))
    once = keyed.join(copies.where("_copies > 0"), same).dropDuplicates(same)
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
