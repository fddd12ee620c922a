"""Label partitions that are replaced at once (S17): a reader sees all of a commit or nothing of it.

Rows are written to a new folder first; a commit then lists, for every label, the folder that holds it, and becomes visible by one rename. Frames opened on an earlier
commit keep reading its files until ``vacuum``. Of two writers that started from the same commit one fails and starts again. The file system's rename of a folder and
exclusive creation of a file must be atomic, as in HDFS.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import partition_value
from .lake import _fs, delete, exists, label_bounds, narrowed


class CommitConflict(RuntimeError):
    """Another writer has the next commit."""


class AtomicPartitions:
    """``root/data/<write>/p_<day>=<label>`` and ``root/commits/<number>``, a table of label and path (one row per label)."""

    def __init__(self, spark: SparkSession, root: str, day: str, granularity: str) -> None:
        self.spark, self.root, self.day, self.granularity = spark, root.rstrip("/"), day, granularity

    def _names(self, path: str) -> list[str]:
        if not exists(self.spark, path):
            return []
        fs, p = _fs(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/commits") if n.isdigit())

    def current(self) -> int:
        """0 before the first commit."""
        return max(self.commits(), default=0)

    def paths(self, commit: int | None = None) -> dict[str, str]:
        """The folder of each label; labels are years to days, so that the driver can hold them."""
        commit = self.current() if commit is None else commit
        if not commit:
            return {}
        if commit not in self.commits():
            raise ValueError(f"no commit {commit} in {self.root}")
        return {r["label"]: r["path"] for r in self.spark.read.parquet(f"{self.root}/commits/{commit}").collect()}

    def replace(self, df: DataFrame, drop: tuple[str, ...] = (), base: int | None = None) -> int:
        """Replaces the labels that ``df`` touches, drops those of ``drop``, keeps all others; returns the commit's number.

        ``base`` is the commit that ``df`` was derived from, the current one by default.
        """
        base = self.current() if base is None else base
        before, label = self.paths(base), f"p_{self.day}"
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        order = [label, *(["symbol"] if "symbol" in df.columns else []), self.day]
        df.withColumn(label, partition_value(F.col(self.day), self.granularity)).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(label).parquet(folder)
        new = {n.split("=", 1)[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{label}=")}
        entries = {k: v for k, v in {**before, **new}.items() if k not in drop or k in new}
        self._publish(base, entries, folder)
        return base + 1

    def _publish(self, base: int, entries: dict[str, str], folder: str) -> None:
        fs, claim = _fs(self.spark, f"{self.root}/claims/{base + 1}")
        if self.current() != base or not fs.createNewFile(claim):
            delete(self.spark, folder)
            raise CommitConflict(f"commit {base + 1} of {self.root} belongs to another writer")
        draft = f"{self.root}/commits/draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(entries.items()), "label string, path string").coalesce(1).write.parquet(draft)
        _, a = _fs(self.spark, draft)
        _, b = _fs(self.spark, f"{self.root}/commits/{base + 1}")
        if not fs.rename(a, b):
            raise CommitConflict(f"commit {base + 1} of {self.root} could not be published")

    def release(self, number: int) -> None:
        """Frees a claim whose writer died before it published."""
        if number in self.commits():
            raise ValueError(f"commit {number} is published")
        delete(self.spark, f"{self.root}/claims/{number}")

    def read(self, start=None, end=None, symbols: list[str] | None = None, commit: int | None = None) -> DataFrame:
        """The rows of a commit; folders are chosen by label, then rows by date and symbol."""
        start, end = (str(x) if x is not None else None for x in (start, end))
        found = self.paths(commit)
        if not found:
            raise ValueError(f"{self.root} has no rows")
        inside = [p for k, p in found.items() if (start is None or label_bounds(k)[1] >= start) and (end is None or label_bounds(k)[0] <= end)]
        # Without a folder in range any one gives the columns.
        df = self.spark.read.parquet(*(inside or list(found.values())[:1]))
        return narrowed(df if inside else df.where("false"), self.day, start, end, symbols)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Forgets all but the last ``keep`` commits and deletes folders that none of the kept ones needs; frames opened on older ones end."""
        every = self.commits()
        kept, gone = every[-keep:], every[:-keep]
        needed = {p for c in kept for p in self.paths(c).values()}
        for write in self._names(f"{self.root}/data"):
            for part in self._names(f"{self.root}/data/{write}"):
                if part.startswith(f"p_{self.day}=") and f"{self.root}/data/{write}/{part}" not in needed:
                    delete(self.spark, f"{self.root}/data/{write}/{part}")
        for c in gone:
            delete(self.spark, f"{self.root}/commits/{c}")
        return gone
