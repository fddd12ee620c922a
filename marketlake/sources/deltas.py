"""Deltas that can be applied (M5): packages of changed rows and deleted keys, chained by digest.

A package holds ``changes`` (one row per key that was added, replaced or deleted, with the new values) and ``manifest`` (the digests of the table it starts from and of
the one it leads to). Applying one needs the base and the package only. Digests are observed in the job that reads the rows anyway.

Defined results: keys are unique and not null, as contracts demand; a row that differs in provenance alone is no change; an empty delta is a package like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.digest import Digest, Observed, business_columns, of_frame, row_halves
from .lake import delete, exists

CHANGE = "_change"


class DeltaError(ValueError):
    """A package does not fit the table or the chain."""


def make_delta(old: DataFrame, new: DataFrame, key: list[str], path: str) -> None:
    """Writes the package that leads from ``old`` to ``new``: one full outer join on the key, both digests observed on its inputs."""
    spark, columns = old.sparkSession, new.columns
    if set(old.columns) != set(columns):
        raise DeltaError("a delta needs tables of the same columns")
    business, rest = business_columns(new), [c for c in columns if c not in key]
    base, target = Observed(), Observed()
    a, b = row_halves(business)
    o = base.on(old, business).select(*key, F.struct(a, b).alias("_o"))
    n = target.on(new, business).select(*key, F.struct(a, b).alias("_n"), F.struct(*rest).alias("_row"))
    change = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "replace")
    changes = o.join(n, key, "full_outer").withColumn(CHANGE, change).where(F.col(CHANGE).isNotNull())
    changes.select(*key, CHANGE, *(F.col("_row")[c].alias(c) for c in rest)).write.parquet(f"{path}/changes")
    counts = {r[CHANGE]: r["count"] for r in spark.read.parquet(f"{path}/changes").groupBy(CHANGE).count().collect()}
    row = (*_flat(base.digest), *_flat(target.digest), *(counts.get(k, 0) for k in ("add", "replace", "delete")))
    spark.createDataFrame([row], "base_rows long, base_a string, base_b string, target_rows long, target_a string, target_b string, n_add long, n_replace long, n_delete long").coalesce(1).write.parquet(f"{path}/manifest")


def _flat(d: Digest) -> tuple[int, str, str]:
    return d.n_rows, str(d.a), str(d.b)


def ends(spark: SparkSession, path: str) -> tuple[Digest, Digest]:
    """The digests that a package starts from and leads to."""
    if not exists(spark, f"{path}/manifest"):
        raise DeltaError(f"{path} is no finished package")
    r = spark.read.parquet(f"{path}/manifest").first()
    return tuple(Digest(r[f"{side}_rows"], int(r[f"{side}_a"]), int(r[f"{side}_b"])) for side in ("base", "target"))


def chained(spark: SparkSession, paths: list[str], key: list[str]) -> tuple[DataFrame, Digest, Digest]:
    """The changes of several packages as one: per key its last. Each package must start where the one before ends."""
    spans = [ends(spark, p) for p in paths]
    for (_, stop), (start, _), path in zip(spans, spans[1:], paths[1:]):
        if stop != start:
            raise DeltaError(f"{path} does not start where the package before it ends")
    every = None
    for i, p in enumerate(paths):
        one = spark.read.parquet(f"{p}/changes").withColumn("_no", F.lit(i))
        every = one if every is None else every.unionByName(one)
    last = Window.partitionBy(*key).orderBy(F.desc("_no"))
    changes = every.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_no")
    return changes, spans[0][0], spans[-1][1]


def apply_deltas(base: DataFrame, paths: list[str], key: list[str], out: str) -> DataFrame:
    """Writes the table that a chain of packages leads to and returns it read back.

    The base's digest and the result's are observed while the result is written; where one of them is not what the packages say, the result is deleted.
    """
    spark, columns = base.sparkSession, base.columns
    changes, start, stop = chained(spark, paths, key)
    seen, made = Observed(), Observed()
    kept = seen.on(base).join(changes.select(*key), key, "left_anti").select(columns)
    result = made.on(kept.unionByName(changes.where(F.col(CHANGE) != "delete").select(columns)))
    result.write.parquet(out)
    # A task that ran twice is observed twice: before a table is refused, it is summed by itself.
    if seen.digest != start and of_frame(base) != start:
        delete(spark, out)
        raise DeltaError("the table is not the one the packages start from")
    if made.digest != stop and of_frame(spark.read.schema(base.schema).parquet(out)) != stop:
        delete(spark, out)
        raise DeltaError("the result is not the one the packages lead to")
    return spark.read.schema(base.schema).parquet(out)
