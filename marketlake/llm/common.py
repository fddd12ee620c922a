"""Shared helpers: tables in the cluster's shared folder, small Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Distinct words a Python worker remembers before it starts over.
WORD_CACHE = 200_000
#: Bytes of text that one step of a Python worker takes at most, a single longer text apart.
STEP_BYTES = 4 << 20
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it read back: lineage ends there. ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500, size: int = STEP_BYTES) -> None:
    """Bounds the rows and bytes that one Arrow batch carries to a Python worker, since texts can be long.

    The setting stays with the session, as plans returned to the caller run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``most`` bytes of text, a single longer text apart."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.diff(step, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(size)]):
            yield batch.slice(a, b - a)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class WordHashes(dict):
    """Remembers the 64-bit hash of each word (bytes); starts over when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WideWordHashes(dict):
    """Remembers two 64-bit hashes of each word (one 128-bit hash), so that two words would have to collide in both."""

    def __init__(self) -> None:
        super().__init__()
        self.halves = np.zeros((2, 1 << 12), np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        if place >= self.halves.shape[1]:
            self.halves = np.concatenate((self.halves, np.zeros_like(self.halves)), axis=1)
        h = xxhash.xxh3_128_intdigest(word)
        self.halves[0, place], self.halves[1, place] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        """2 x words."""
        if len(self) >= WORD_CACHE:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.halves[:, at]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift), vectorized."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]
