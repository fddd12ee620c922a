"""Reading and writing the lake.

A dataset lies under ``root/dataset/p_<column>=<label>/``; labels name years, quarters, months or days and may be mixed. The label
never replaces the real date column. Generations lie under ``gen=N`` and a manifest names the current one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import partition_value
from ..operators.canonical import canonical, upsert
from ..operators.digest import Observed
from ..operators.paging import page_with_total
from ..registry import Dataset

T = TypeVar("T")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place of ``spark.checkpoint.dir``; in local mode without one, in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared place and read back: what follows may read it several times, and lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_bounds(label: str) -> tuple[str, str]:
    """First and last day a partition label covers, as ISO strings (months end on 31 for comparison)."""
    if "Q" in label:
        year, q = label.split("Q")
        return f"{year}-{3 * int(q) - 2:02d}-01", f"{year}-{3 * int(q):02d}-31"
    return {4: (f"{label}-01-01", f"{label}-12-31"), 7: (f"{label}-01", f"{label}-31")}.get(len(label), (label, label))


def overlaps(label, start: str | None, end: str | None):
    """A filter on coarse labels: those whose period meets [start, end]. Spark prunes directories by it."""
    year, quarter = F.substring(label, 1, 4), F.substring(label, 6, 1).cast("int")
    is_q, n = F.substring(label, 5, 1) == "Q", F.length(label)
    first = F.when(is_q, F.concat(year, F.lit("-"), F.lpad((3 * quarter - 2).cast("string"), 2, "0"), F.lit("-01"))).when(n == 4, F.concat(label, F.lit("-01-01"))).when(n == 7, F.concat(label, F.lit("-01"))).otherwise(label)
    last = F.when(is_q, F.concat(year, F.lit("-"), F.lpad((3 * quarter).cast("string"), 2, "0"), F.lit("-31"))).when(n == 4, F.concat(label, F.lit("-12-31"))).when(n == 7, F.concat(label, F.lit("-31"))).otherwise(label)
    out = F.lit(True)
    out = out & (last >= start) if start else out
    return out & (first <= end) if end else out


def scan(
    spark: SparkSession, root: str, day: str | None = None, start: date | str | None = None, end: date | str | None = None, symbols: list[str] | None = None, contract: Dataset | None = None
) -> DataFrame:
    """A lazy pruned scan: directories by label, then rows by the real date and symbol (pushed to Parquet).

    With a contract its columns are read and older files give null for those they lack; without one, the schemas of all
    files are merged, which reads every footer.
    """
    label = f"p_{day}" if day else None
    if contract is not None:
        df = spark.read.schema(contract.schema.add(label, "string") if label else contract.schema).parquet(root)
    else:
        df = spark.read.option("mergeSchema", True).parquet(root)
    start, end = (str(x) if x is not None else None for x in (start, end))
    if label in df.columns:
        df = df.where(overlaps(F.col(label).cast("string"), start, end))
    df = narrowed(df, day, start, end, symbols)
    return df.drop(label) if label in df.columns else df


def narrowed(df: DataFrame, day: str | None, start, end, symbols: list[str] | None) -> DataFrame:
    """Rows of a date range and of symbols, where the columns are there."""
    kind = dict(df.dtypes).get(day)
    bound = lambda x: F.lit(str(x)).cast("date") if kind != "string" else F.lit(quarter_of(x))
    if kind and start is not None:
        df = df.where(F.col(day) >= bound(start))
    if kind and end is not None:
        df = df.where(F.col(day) <= bound(end))
    if symbols is not None and "symbol" in df.columns:
        df = df.where(F.col("symbol").isin(*symbols)) if len(symbols) <= 1000 else df.join(df.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string"), "symbol", "left_semi")
    return df


def quarter_of(day: date | str) -> str:
    year, month = str(day)[:4], int(str(day)[5:7])
    return f"{year}Q{(month + 2) // 3}"


#: Tasks that write one partition label, so that a year of minute bars is not one task.
WRITERS = 8


def write_partitions(df: DataFrame, root: str, day: str, granularity: str) -> None:
    """Overwrites the partitions that ``df`` touches and no others. Each label is written by up to ``WRITERS`` tasks, dealt by symbol; files are sorted by symbol and day."""
    labelled = df.withColumn(f"p_{day}", partition_value(F.col(day), granularity))
    dealt = [F.pmod(F.xxhash64("symbol"), F.lit(WRITERS))] if "symbol" in df.columns and granularity in ("year", "quarter", "month") else []
    order = [f"p_{day}", *(["symbol"] if "symbol" in df.columns else []), day]
    labelled.repartition(f"p_{day}", *dealt).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(f"p_{day}").parquet(root)


def write_clustered(df: DataFrame, root: str, day: str, granularity: str, by: str = "symbol", page_rows: int = 20_000, group_bytes: int = 32 << 20) -> None:
    """Overwrites the partitions that ``df`` touches, with rows sorted by (``by``, day) within each label.

    Rows are dealt by ranges of (label, ``by``, day), so that each file holds a range of its own, however many rows one symbol has; footers, page indexes and
    Bloom filters on ``by`` then let a scan of a few symbols skip files, row groups and pages.
    """
    label = f"p_{day}"
    order = [label, by, day]
    labelled = df.withColumn(label, partition_value(F.col(day), granularity))
    writer = labelled.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    layout = {"parquet.block.size": group_bytes, "parquet.page.row.count.limit": page_rows, f"parquet.bloom.filter.enabled#{by}": True, "parquet.bloom.filter.adaptive.enabled": True}
    writer.options(**layout).partitionBy(label).parquet(root)


def measured(spark: SparkSession, action: Callable[[], T]) -> tuple[T, dict[str, int]]:
    """What ``action`` returns, and the rows and bytes that its jobs read from files, after files, row groups and pages were skipped."""
    group, sc = f"measured-{uuid.uuid4().hex}", spark.sparkContext
    before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setLocalProperty("spark.jobGroup.id", group)
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
    jsc = sc._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    tracker, read = sc.statusTracker(), {"rows": 0, "bytes": 0}
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    for stage in stages:
        if (info := tracker.getStageInfo(stage)) and info.numCompletedTasks:  # skipped stages have run none
            found = jsc.statusStore().lastStageAttempt(stage)
            read["rows"] += found.inputRecords()
            read["bytes"] += found.inputBytes()
    return out, read


@dataclass(frozen=True)
class Read:
    """Rows that were written aside, and what it took to read them."""

    table: DataFrame
    read: dict[str, int]


def kept_rows(df: DataFrame, name: str = "kept") -> Read:
    """Runs ``df`` once: its rows, kept in the shared place, with the rows and bytes that were read for them."""
    return Read(*measured(df.sparkSession, lambda: kept(df, name)))


def compact(spark: SparkSession, staged: DataFrame, root: str, key: list[str], day: str, granularity: str, **sources) -> bool:
    """Merges staged rows into their partitions, one canonical row per key; publishes only if business content changed.

    The touched partitions are read and merged once: digests of the stored and of the merged rows are observed while the merged rows are written aside.
    """
    touched = staged.select(partition_value(F.col(day), granularity).alias(f"p_{day}")).distinct()
    if not exists(spark, root):
        write_partitions(canonical(staged, key, **sources), root, day, granularity)
        return True
    stored = spark.read.parquet(root)
    columns = [c for c in stored.columns if c != f"p_{day}"]
    before, after = Observed(), Observed()
    stored = before.on(stored.join(F.broadcast(touched), f"p_{day}", "left_semi").select(columns))
    merged = after.on(upsert(stored, staged, key, **sources).select(columns))
    # Spark does not overwrite what a plan reads: the merged rows are written beside the table first, in a folder of this call.
    aside = f"{root.rstrip('/')}_merge_{uuid.uuid4().hex}"
    merged.write.parquet(aside)
    changed = before.digest != after.digest
    if changed:
        write_partitions(spark.read.parquet(aside), root, day, granularity)
    delete(spark, aside)
    return changed


def repartition_dataset(spark: SparkSession, root: str, to: str, day: str, granularity: str) -> int:
    """Rewrites a dataset at another granularity; row counts must agree."""
    df = scan(spark, root, day)
    n = df.count()
    write_partitions(df, to, day, granularity)
    if (m := spark.read.parquet(to).count()) != n:
        raise RuntimeError(f"{m} rows written of {n}")
    return n


def partition_stats(spark: SparkSession, root: str, day: str) -> DataFrame:
    """Rows, files and bytes per partition label."""
    df = spark.read.parquet(root).select(f"p_{day}", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
    files = df.groupBy(F.col(f"p_{day}").cast("string").alias("label"), "f").agg(F.count("*").alias("n"), F.first("b").alias("b"))
    return files.groupBy("label").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), F.sum("b").alias("n_bytes"))


def provenance(df: DataFrame, day: str, granularity: str) -> DataFrame:
    """Rows and fetch span per partition label, source and version."""
    return df.groupBy(partition_value(F.col(day), granularity).alias("label"), "source", "data_version").agg(F.count("*").alias("n_rows"), F.min("fetched_at").alias("first_fetch"), F.max("fetched_at").alias("last_fetch"))


def provenance_series(df: DataFrame, day: str, most: int) -> DataFrame:
    """Provenance at the finest granularity that yields at most ``most`` labels."""
    for granularity in ("day", "month", "year"):
        if granularity == "year" or df.select(partition_value(F.col(day), granularity)).distinct().limit(most + 1).count() <= most:
            return provenance(df, day, granularity)
    raise AssertionError


def delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys added, replaced or deleted between two generations."""
    rest = [c for c in new.columns if c not in key]
    o = old.select(*key, F.xxhash64(*rest).alias("_o"))
    n = new.select(*key, F.xxhash64(*rest).alias("_n"))
    change = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "replace")
    return o.join(n, key, "full_outer").select(*key, change.alias("change")).where("change IS NOT NULL")


class Generations:
    """Versioned tables: ``gen=N`` folders and a manifest of commits."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        if not exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], "gen int, committed_at timestamp, n_rows long")
        return self.spark.read.parquet(f"{self.root}/manifest")

    def current(self) -> int | None:
        return self.manifest().agg(F.max("gen")).first()[0]

    def _claimed(self) -> int:
        """The next number that no other writer has: its claim is a file that only one can create."""
        gen = (self.current() or 0) + 1
        while True:
            fs, p = _fs(self.spark, f"{self.root}/claims/{gen}")
            if fs.createNewFile(p):
                return gen
            gen += 1

    def commit(self, df: DataFrame) -> int:
        gen = self._claimed()
        df.write.parquet(f"{self.root}/gen={gen}")
        n = self.spark.read.parquet(f"{self.root}/gen={gen}").count()
        row = self.spark.createDataFrame([(gen, n)], "gen int, n_rows long").select("gen", F.current_timestamp().alias("committed_at"), "n_rows")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return gen

    def read(self, gen: int | None = None) -> DataFrame:
        """The current generation or a pinned one; the path is fixed when the frame is built."""
        gen = self.current() if gen is None else gen
        if gen is None or not exists(self.spark, f"{self.root}/gen={gen}"):
            raise ValueError(f"no generation {gen} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/gen={gen}")

    def prune(self, keep: int) -> list[int]:
        """Deletes all but the last ``keep`` generations; the manifest still lists them."""
        gens = sorted(r["gen"] for r in self.manifest().select("gen").distinct().collect())
        gone = gens[: max(0, len(gens) - keep)]
        for g in gone:
            fs, p = _fs(self.spark, f"{self.root}/gen={g}")
            fs.delete(p, True)
        return gone


def catalog(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and date bounds of each (frame, date column)."""
    out = None
    for name, (df, day) in sorted(frames.items()):
        one = df.agg(F.count("*").alias("n_rows"), F.min(day).alias("coverage_start"), F.max(day).alias("coverage_end")).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def incremental_sessions(sessions: DataFrame, watermark, until) -> DataFrame:
    return sessions.where((F.col("trade_date") > F.lit(watermark).cast("date")) & (F.col("trade_date") <= F.lit(until).cast("date")))


def newest_run(runs: DataFrame, key: list[str]) -> DataFrame:
    """Of appended source snapshots, the rows of the newest run per key."""
    last = runs.groupBy(*key).agg(F.max("run_ts").alias("run_ts"))
    return runs.join(last, [*key, "run_ts"], "left_semi")


def stale_runs(runs: DataFrame, as_of, days: int) -> DataFrame:
    """Staged runs past their retention."""
    return runs.where(F.datediff(F.lit(as_of).cast("date"), F.col("run_ts").cast("date")) > days)


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """Free SQL over the registered views, with the honest total; with a limit both come from one run of the query."""
    df = spark.sql(text)
    if limit is None:
        return df, df.count()
    page = page_with_total(df, limit)
    return page.rows, page.total
