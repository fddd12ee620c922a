"""Operator 8, sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are dealt by ranges of doc_id and sorted; each partition's totals (one row per partition) give the offset of its
first byte and row; a running sum within the partition then gives every row's global position, and the
position of its first byte picks its shard. Only ids, sizes and checksums are shuffled, never texts.

Defined results: a null text has size 1 and the checksum of no bytes; null ids come first; rows that repeat an id are
ordered by size and checksum; extra columns stay, whatever their names, but for shard and slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

SHARDS = 8


def _placed(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """row (all columns), before, place and total of each row in the given order; columns of ``rows`` do not meet these names."""
    keys = [f"o{i}" for i in range(len(order))]
    packed = rows.select(F.struct("*").alias("row"), F.col(f"`{size}`").alias("size"), *(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)))
    dealt = materialize(packed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    totals = [tuple(r) for r in dealt.groupBy("part").agg(F.sum("size"), F.count("*")).orderBy("part").collect()]
    offsets, at, n = [], 0, 0
    for part, b, c in totals:
        offsets.append((part, at, n))
        at, n = at + b, n + c
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, bytes long, rows long"))
    within = Window.partitionBy("part").orderBy(*keys)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(offset, "part").select(
        "row",
        (F.col("bytes") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("before"),
        (F.col("rows") + F.row_number().over(within) - 1).alias("place"),
        F.lit(at).cast("long").alias("total"),
    )


def _unpacked(rows: DataFrame, placed: DataFrame, *added: str) -> DataFrame:
    return placed.select(*(F.col("row").getField(c).alias(c) for c in rows.columns if c not in added), *added)


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds ``before`` (bytes of all earlier rows), ``place`` (number of earlier rows) and ``total`` in the given order; columns of these names are replaced."""
    return _unpacked(rows, _placed(rows, order, size), "before", "place", "total")


def byte_shards(rows: DataFrame, order: list[str], size: str, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot``: shard i starts with the first row whose offset reaches i / shards of all bytes. Columns of these names are replaced."""
    placed = materialize(_placed(rows, order, size).withColumn("shard", F.expr(f"CAST(before * {shards} DIV total AS INT)")), "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return _unpacked(rows, placed.join(first, "shard").withColumn("slot", F.col("place") - F.col("first")), "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = byte_shards(materialize(sized, "sizes"), ["doc_id", "size", "text_crc32"], "size")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
