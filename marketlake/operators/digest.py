"""Order-free content digests that add up.

A row's digest is made of two 60-bit halves of the MD5 of its business columns; a table's is its row count and the sums of both. Digests of disjoint parts add to
that of the whole, and a part can be taken out again, so that what did not change is not read again. Sums of at most 10^20 rows fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

PROVENANCE = ("source", "data_version", "fetched_at")


def business_columns(df: DataFrame, provenance: tuple[str, ...] = PROVENANCE) -> list[str]:
    return sorted(c for c in df.columns if c not in provenance)


def row_halves(columns: list[str]) -> tuple[Column, Column]:
    """Both halves of a row's digest; a null differs from every text."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    h = F.md5(F.concat(*(field(F.col(f"`{c}`").cast("string")) for c in columns)).cast("binary"))
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("long")
    return half(1), half(16)


def aggregates(columns: list[str]) -> list[Column]:
    """Aggregates n_rows, digest_a and digest_b, for ``agg``, ``groupBy().agg`` and ``observe``."""
    return sums(*row_halves(columns))


def sums(a: Column, b: Column) -> list[Column]:
    """``aggregates`` of halves that a projection holds, so that a row's MD5 is taken once, however often the sums mention it."""
    return [F.count(F.lit(1)).alias("n_rows"), _sum(a).alias("digest_a"), _sum(b).alias("digest_b")]


def _sum(half: Column) -> Column:
    """The sum of 60-bit numbers in 38 digits: upper and lower 30 bits are summed as longs, which hold 8 billion rows, as a decimal for each row costs more than its MD5."""
    part = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,0)")
    return (part(F.shiftright(half, 30)) * F.lit(1 << 30).cast("decimal(10,0)") + part(half.bitwiseAND(F.lit((1 << 30) - 1)))).cast("decimal(38,0)")


@dataclass(frozen=True)
class Digest:
    n_rows: int = 0
    a: int = 0
    b: int = 0

    def __add__(self, other: Digest) -> Digest:
        return Digest(self.n_rows + other.n_rows, self.a + other.a, self.b + other.b)

    def __sub__(self, other: Digest) -> Digest:
        return Digest(self.n_rows - other.n_rows, self.a - other.a, self.b - other.b)


def of_row(row) -> Digest:
    return Digest(int(row["n_rows"]), int(row["digest_a"]), int(row["digest_b"]))


def of_frame(df: DataFrame, provenance: tuple[str, ...] = PROVENANCE) -> Digest:
    return of_row(df.agg(*aggregates(business_columns(df, provenance))).first())


class Observed:
    """The digest of what passes through a frame, known when the action that reads it has ended: no pass of its own."""

    def __init__(self) -> None:
        self.observation = Observation()

    def on(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return df.observe(self.observation, *aggregates(columns or business_columns(df)))

    @property
    def digest(self) -> Digest:
        return of_row(self.observation.get)
