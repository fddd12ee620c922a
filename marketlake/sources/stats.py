"""Statistics that are kept and brought up to date (M4, A13, A15): one row per file, source and version.

A file is known by its path, length and time of change. A refresh lists the files, reads those that are new or changed, drops rows of files that are gone and
commits a new generation of the table. Labels, provenance and digests of the whole dataset are sums and extremes of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digest import Digest, business_columns, of_row, row_halves, sums
from .lake import Generations, delete, exists

IDENTITY = ["path", "length", "modified"]


def _path(c: Column) -> Column:
    """One spelling of a path: listings and scans differ in the slashes after the scheme and in escapes."""
    return F.url_decode(F.replace(F.regexp_replace(c, "^([a-zA-Z0-9+.-]+):/+", "$1:/"), F.lit("+"), F.lit("%2B")))


class Statistics:
    """Kept statistics of a dataset partitioned by ``p_<day>``."""

    def __init__(self, spark: SparkSession, root: str, day: str) -> None:
        self.spark, self.root, self.day = spark, root.rstrip("/"), day
        self.store = Generations(spark, f"{self.root}_stats")

    def listing(self) -> DataFrame:
        """The dataset's files by identity; contents are not read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.root)
        return found.select("path", "length", F.col("modificationTime").alias("modified"))

    def _read(self, paths: list[str] | None) -> DataFrame:
        reader = self.spark.read.option("basePath", self.root)
        rows = reader.parquet(self.root) if paths is None else reader.parquet(*paths)
        rows = rows.select("*", _path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_size").alias("_length"), F.col("_metadata.file_modification_time").alias("_modified"))
        label = f"p_{self.day}"
        business = business_columns(rows.drop("_path", "_length", "_modified", label))
        kept = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("data_version", "string"))]
        fetched = F.col("fetched_at").cast("timestamp") if "fetched_at" in rows.columns else F.lit(None).cast("timestamp")
        by = [F.col("_path").alias("path"), F.col("_length").alias("length"), F.col("_modified").cast("timestamp").alias("modified"), F.col(label).cast("string").alias("label"), *kept]
        a, b = row_halves(business)
        return rows.withColumns({"_half_a": a, "_half_b": b}).groupBy(*by).agg(
            *sums(F.col("_half_a"), F.col("_half_b")), F.min(fetched).alias("first_fetch"), F.max(fetched).alias("last_fetch"), F.min(self.day).alias("first_day"), F.max(self.day).alias("last_day")
        )

    def refresh(self) -> int:
        """Brings the statistics up to date; returns how many files were read. Paths of changed files are all that reaches the driver."""
        if self.store.current() is None:
            fresh = self._read(None)
            self.store.commit(fresh)
            return self.files().select("path").distinct().count()
        listed = self.listing().withColumn("_raw", F.col("path")).withColumn("path", _path(F.col("path"))).withColumn("modified", F.col("modified").cast("timestamp"))
        stored = self.files()
        changed = [r["_raw"] for r in listed.join(stored.select(*IDENTITY).distinct(), IDENTITY, "left_anti").select("_raw").toLocalIterator()]
        held = stored.join(listed.select(*IDENTITY), IDENTITY, "left_semi")
        if not changed and held.count() == stored.count():
            return 0
        self.store.commit(held.unionByName(self._read(changed)) if changed else held)
        self.store.prune(2)
        return len(changed)

    def rebuild(self) -> int:
        """Forgets what is stored and reads all files."""
        if exists(self.spark, self.store.root):
            delete(self.spark, self.store.root)
        return self.refresh()

    def files(self) -> DataFrame:
        return self.store.read()

    def partitions(self) -> DataFrame:
        """A15 from kept rows: rows, files, bytes, span and digest per label."""
        per_file = self.files().groupBy("label", "path").agg(F.sum("n_rows").alias("n"), F.first("length").alias("b"), F.min("first_day").alias("d0"), F.max("last_day").alias("d1"), F.sum("digest_a").alias("da"), F.sum("digest_b").alias("db"))
        total = lambda c, name: F.sum(c).cast("decimal(38,0)").alias(name)
        return per_file.groupBy("label").agg(
            F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), F.sum("b").alias("n_bytes"), F.min("d0").alias("first_day"), F.max("d1").alias("last_day"), total("da", "digest_a"), total("db", "digest_b")
        )

    def provenance(self) -> DataFrame:
        """A13 from kept rows: rows and fetch span per label, source and version."""
        return self.files().groupBy("label", "source", "data_version").agg(F.sum("n_rows").alias("n_rows"), F.min("first_fetch").alias("first_fetch"), F.max("last_fetch").alias("last_fetch"))

    def digest(self, labels: list[str] | None = None) -> Digest:
        """The digest of the dataset, or of some labels, without reading it."""
        rows = self.files() if labels is None else self.files().where(F.col("label").isin(labels))
        zero = F.lit(0).cast("decimal(38,0)")
        return of_row(rows.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *(F.coalesce(F.sum(c), zero).alias(c) for c in ("digest_a", "digest_b"))).first())
