"""The register of queries: a callable over fixtures and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

Frames = Callable[[str], DataFrame]
QUERIES: dict[str, tuple[Callable[[Frames], DataFrame], str | None, tuple[str, ...]]] = {}


def query(name: str, uses: str, sql: str | None = None) -> Callable:
    """Registers a function of ``fx`` (fixture or table name to DataFrame); ``uses`` lists the fixtures that ``sql`` reads."""

    def add(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = (f, sql, tuple(u for u in uses.split() if u in fixtures.FIXTURES))
        return f

    return add


#: Keys compress well in a shuffle (14 bytes a line item): 64 MB of it (Spark's default) take many times that in a task's hash tables and sorts.
PARTITION_SIZE = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
#: Adaptive execution joins small partitions up to that size, but never splits one: there are enough of them to begin with, so that a task's memory stays as the input grows.
PARTITIONS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "2000")
#: A scan's task groups or sorts all lines of its split before the shuffle; 128 MB (Spark's default) are millions of lines.
SPLIT_SIZE = ("spark.sql.files.maxPartitionBytes", "16m")


def runner(f: Callable[[Frames], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for key, value in (PARTITION_SIZE, PARTITIONS, SPLIT_SIZE):
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        return f(lambda name: fixtures.frame(spark, sf_dir, name))

    return run


def full_sql(sql: str, uses: tuple[str, ...]) -> str:
    head = fixtures.duckdb(uses) if uses else ""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}{', ' if head else ''}{body[5:]}"
    return f"WITH {head} {body}" if head else body
