"""Operator 4, exact top-k search by distributed histogram selection.

Everything is scored. Queries come in waves of at most ``WAVE`` rows and ``WAVE_BYTES`` of components; in one job per round,
every task scores its candidates against a whole wave by matrix product, ``TILE`` queries at a time, and counts them in a
histogram per query over the range that still holds the kth value. The histograms are summed by Spark, the range narrows to the
bin of the kth value, and after a few rounds the value is known. A last pass keeps the scores at or above it; ties go to the
smaller id. The first range is as narrow as the norms of query and candidates allow, so that rounds over all candidates are few.

Bound on the driver: one wave of queries with two numbers each, and a number per partition of the queries. A task reports only
bins at or above its own kth value, since the global kth cannot lie lower. Beyond one wave, the waves' results go to one table.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate; of vectors of
unequal lengths, missing components count as 0; fewer than k candidates are all returned; rows that repeat an id are
candidates each, but not of a query of that id, and one query: the least of their vectors, component by component; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_table, read, small_batches

WAVE, WAVE_BYTES, TILE, BINS = 32768, 64 << 20, 1024, 512
_BEST = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, identity: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of every component, of the vectors that are whole."""
    x = F.col(vector)
    whole = x.isNotNull() & F.col(identity).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(whole).select(
        F.col(identity).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("q")
    )


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of the batch as int64, padded to a width; candidates' further components meet zeros and are cut."""
    column = batch.column("q")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (s, e) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        part = flat[s:e][:width]
        out[i, : len(part)] = part
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point while every partial sum is an exact integer."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if most < exact:
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return q @ c.T


def _tiles(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """A run of queries, candidate ids, the run's scores of these, and where a candidate is the query itself."""
    for batch in batches:
        own = batch.column("id").to_numpy()
        c = _matrix(batch, q.shape[1])
        for low in range(0, len(ids), TILE):
            run = slice(low, low + TILE)
            yield run, own, _scores(q[run], c), ids[run, None] == own[None, :]


def _histograms(ids: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """Counts per query and bin; bin BINS holds all scores above the range, and lower ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), BINS + 1), np.int32)
        for at, _, s, itself in _tiles(batches, ids, q):
            cell = np.minimum((s - low[at, None]) // width[at, None], BINS)
            use = (cell >= 0) & ~itself
            cell += np.arange(len(cell))[:, None] * (BINS + 1)
            total[at] += np.bincount(cell[use], minlength=len(cell) * (BINS + 1)).reshape(len(cell), -1).astype(np.int32)
        for first in range(0, len(ids), TILE):
            part = total[first : first + TILE].astype(np.int64)
            above = np.cumsum(part[:, ::-1], axis=1)[:, ::-1] - part
            row, cell = np.nonzero((part > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array((row + first).astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(part[row, cell])], names=["row", "bin", "n"])

    return run


def _best(ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
    """Each task's best k candidates per query among the scores at or above the kth value."""

    def best(rows: np.ndarray, cands: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((cands, -scores, rows))
        rows, cands, scores = rows[order], cands[order], scores[order]
        stays = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        return rows[stays], cands[stays], scores[stays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {low: (np.zeros(0, np.int64),) * 3 for low in range(0, len(ids), TILE)}
        for at, own, s, itself in _tiles(batches, ids, q):
            r, c = np.nonzero((s >= kth[at, None]) & ~itself)
            if len(r):
                held[at.start] = best(*(np.append(x, y) for x, y in zip(held[at.start], (r + at.start, own[c], s[r, c]))))
        for rows, cands, scores in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(cands), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def _waves(queries: DataFrame, n: int, rows: int) -> Iterator[DataFrame]:
    """The queries in runs of ``rows`` (the last one shorter), by their places in a table that is written once."""
    if n <= rows:
        yield queries
        return
    numbered = materialize(queries.repartitionByRange("id").sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id()), "queries")
    counts = numbered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    for low in range(0, n, rows):
        held, before = F.lit(False), 0
        for r in counts:
            first, last = max(low, before), min(low + rows, before + r["n"]) - 1
            if first <= last:
                base = (r["part"] << 33) - before
                held = held | F.col("place").between(base + first, base + last)
            before += r["n"]
        yield numbered.where(held)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (id, q) of each query (id, q), its own id left out."""
    spark = queries.sparkSession
    queries = materialize(queries.groupBy("id").agg(F.min("q").alias("q")), "queries")
    n, longest = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    best = spark.createDataFrame([], _BEST)
    if n:
        squares = F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
        most, norm = (x or 0 for x in candidates.agg(F.max(F.array_max(F.transform("q", F.abs))), F.sqrt(F.max(squares))).first())
        rows = max(1, min(WAVE, WAVE_BYTES // (8 * max(1, longest))))
        found = (_wave(wave, candidates, k, int(most), float(norm)) for wave in _waves(queries, n, rows))
        if n <= rows:
            best = next(found)
        else:
            path = new_table(spark, "best")
            for one in found:
                one.write.mode("append").parquet(path)
            best = spark.read.schema(_BEST).parquet(path)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(q: np.ndarray, most: int, norm: float) -> np.ndarray:
    """What no score of each query exceeds, in either direction, by the largest component and by the largest norm of the candidates."""
    by_size = np.abs(q).sum(axis=1) * most
    by_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * norm * (1 + 1e-9) + 1
    return np.where(by_norm < by_size, np.ceil(np.minimum(by_norm, 2.0**61)).astype(np.int64), by_size)


def _wave(wave: DataFrame, candidates: DataFrame, k: int, most: int, norm: float) -> DataFrame:
    rows = wave.select("id", "q").collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    q = np.zeros((len(rows), max(1, *(len(r["q"]) for r in rows))), np.int64)
    for i, r in enumerate(rows):
        q[i, : len(r["q"])] = r["q"]
    reach = _reach(q, most, norm)
    low, high = -reach, reach
    while True:
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        counted = candidates.mapInArrow(_histograms(ids, q, low, width, k), "row int, bin int, n long")
        # Tasks' counts of one bin are peers in the window's order: one shuffle sums them and finds the bin of the kth score.
        reached = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        at = counted.withColumn("reached", reached).where(F.col("reached") >= k).groupBy("row").agg(F.max("bin").alias("bin")).collect()
        # A query with fewer than k candidates keeps all scores.
        row, cell = np.array([(r["row"], r["bin"]) for r in at], np.int64).reshape(-1, 2).T
        new_low, new_high = -reach, -reach
        new_low[row] = low[row] + cell * width[row]
        new_high[row] = new_low[row] + width[row] - 1
        low, high = new_low, new_high
        if (width == 1).all() or (low == high).all():
            break
    return candidates.mapInArrow(_best(ids, q, low, k), _BEST)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    vectors = materialize(quantized(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "vectors")
    return top_k(vectors.where("id % 50 = 0"), vectors, 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM u a JOIN v b ON a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
