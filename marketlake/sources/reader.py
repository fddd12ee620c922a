"""The semantic reader of a lake (S2, S5, S7-S9, S13, S16, S20, P12, T1): scan, universe, dedupe, adjustment or point in time, order.

A lake has ``root/<layer>/<dataset>`` in label partitions, and, where a dataset is committed in generations,
``root/<layer>/<dataset>/gen=N`` beside a ``manifest``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from ..functions.market import finite, valid_bar
from ..operators import adjust as A
from ..operators.canonical import canonical
from ..operators.pit import read_pit
from ..operators.universe import PROFILES, apply_universe
from ..registry import DATASETS, Dataset, dataset
from . import lake
from .lake import work_dir  # noqa: F401

ADJUSTABLE = ("daily_bars", "minute_bars", "minute_bars_5m", "trade_ticks")


class ReaderError(ValueError):
    """A request that the lake cannot answer."""


def read_files(spark: SparkSession, paths: list[str], contract: Dataset | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A table over given files, merged by name. With a contract its columns come first and absent ones are null, so that no footer is read to plan."""
    if contract is None:
        return spark.read.option("mergeSchema", True).parquet(*paths)
    wanted = contract.schema
    for c in extra:
        wanted = wanted.add(c, StringType())
    return spark.read.schema(wanted).parquet(*paths)


def cast_to_contract(df: DataFrame, contract: Dataset) -> DataFrame:
    """Columns cast leniently to the contract; ``bad`` lists what breaks it: failed casts, missing required values, blanks, non-finite numbers, bar rules."""
    have = {c.lower() for c in df.columns}
    fields = [f for f in contract.schema if f.name in have]
    typed = {f.name.lower(): f.dataType for f in df.schema}

    def lenient(f) -> Column:
        if typed[f.name] == f.dataType:
            return F.col(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return F.try_to_timestamp(F.col(f.name).cast("string")).cast(f.dataType)
        return F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")

    cast = {f.name: lenient(f) for f in fields}
    # Reasons are concatenated, as array functions with a lambda keep Spark from compiling the stage.
    reason = lambda broken, text: F.when(broken, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    failed = [reason(F.col(n).isNotNull() & c.isNull(), f"cast:{n}") for n, c in cast.items()]
    missing = [reason(cast[k].isNull() if k in cast else F.lit(True), f"missing:{k}") for k in contract.key]
    blank = [reason(F.trim(cast[f.name]) == "", f"blank:{f.name}") for f in fields if isinstance(f.dataType, StringType) and f.name in contract.key]
    odd = [reason(~finite(cast[f.name]), f"finite:{f.name}") for f in fields if f.dataType.simpleString() == "double"]
    out = df.select(F.concat(*failed, *missing, *blank, *odd).alias("bad"), *(c.alias(n) for n, c in cast.items()))
    if {"open", "high", "low", "close", "volume", "amount"} <= set(cast):
        out = out.withColumn("bad", F.when(valid_bar(), F.col("bad")).otherwise(F.array_append("bad", F.lit("bar"))))
    return out


def quarantine(df: DataFrame, contract: Dataset) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their reasons."""
    checked = cast_to_contract(df, contract)
    return checked.where(F.size("bad") == 0).drop("bad"), checked.where(F.size("bad") > 0)


def contract_order(df: DataFrame, day: str | None = None) -> list[str]:
    """The order in which a dataset is handed out."""
    for order in (("symbol", "trade_date", "tick_seq"), ("symbol", "bar_time")):
        if order[-1] in df.columns:
            return list(order)
    if "announce_date" in df.columns:
        return [c for c in ("announce_date", "symbol", "report_period", "item_code") if c in df.columns]
    return [c for c in (day, "symbol") if c and c in df.columns]


def landed_intervals(rows: DataFrame) -> DataFrame:
    """Landed sheet rows (code, start, class code as text) to one (symbol, start_date, industry_code) each."""
    from ..functions.symbols import format_symbol, infer_exchange

    code = F.lpad(F.trim("code"), 6, "0")
    day = F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim("start"), "/", "-"), F.lit("yyyy-MM-dd")))
    out = rows.select(format_symbol(code, infer_exchange(code)).alias("symbol"), day.alias("start_date"), F.trim("industry").alias("industry_code"))
    return out.where("start_date IS NOT NULL AND industry_code <> ''").distinct()


@dataclass(frozen=True)
class Lake:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{dataset(name).layer}/{name}"

    def state(self, name: str) -> DataFrame:
        """The latest committed generation of a dataset (no row where none was committed), from the manifest alone."""
        gens = lake.Generations(self.spark, self.path(name)).manifest()
        return gens.orderBy(F.desc("gen")).limit(1).select(F.lit(name).alias("dataset"), F.col("gen").alias("revision"), F.col("committed_at").alias("revision_at"), "n_rows")

    def scan(self, name: str, start=None, end=None, symbols: list[str] | None = None, revision: int | None = None) -> DataFrame:
        """Pruned rows of a dataset, of a pinned generation if asked; a dataset without files is an empty table of its schema."""
        d = dataset(name)
        if revision is not None or lake.exists(self.spark, f"{self.path(name)}/manifest"):
            try:
                df = lake.Generations(self.spark, self.path(name)).read(revision)
            except ValueError as e:
                raise ReaderError(str(e)) from e
            return lake.narrowed(df, d.partition or None, start, end, symbols)
        if not lake.exists(self.spark, self.path(name)):
            return d.empty(self.spark)
        return lake.scan(self.spark, self.path(name), d.partition or None, start, end, symbols, contract=d)

    def canonical(self, name: str, **scope) -> DataFrame:
        """One row per key, as the dataset's view shows it."""
        return canonical(self.scan(name, **scope), list(dataset(name).key), evidence=name == "trading_status")

    def register_views(self, names: list[str] | None = None) -> None:
        """A view per dataset, typed and empty where the lake has no files; daily_bars_adj beside them."""
        for name in names or DATASETS:
            self.canonical(name).createOrReplaceTempView(name)
        if not names or {"daily_bars", "adj_factors"} <= set(names):
            A.daily_bars_adj(self.canonical("daily_bars"), self.canonical("adj_factors")).createOrReplaceTempView("daily_bars_adj")

    def load(
        self, name: str, start=None, end=None, adjust: str | None = None, universe: str | None = None, profile: str | None = None, as_of=None, items: list[str] | None = None,
        symbols: list[str] | None = None, strict_adj: bool = False, strict_universe: bool = False, all_vintages: bool = False, pit_mode: str | None = None, revision: int | None = None, revision_map: dict[str, int] | None = None, ordered: bool = True,
    ) -> DataFrame:
        """Scan, one row per key, universe, adjustment or point in time, contract order.

        ``revision`` pins the dataset itself; ``revision_map`` pins any dataset the read touches. A point-in-time dataset needs ``as_of``; without
        ``pit_mode`` facts must also have been fetched by then. A profile sets universe and strictness. Who aggregates or joins the rows passes
        ``ordered=False`` and spares the sort of the whole result.
        """
        if name not in DATASETS:
            raise ReaderError(f"unknown dataset {name!r}")
        if revision is not None and revision_map is not None:
            raise ReaderError("give either revision or revision_map")
        pins = revision_map or ({name: revision} if revision is not None else {})
        if profile is not None:
            found = next((p for p in PROFILES if p.name == profile), None)
            if found is None or universe not in (None, found.universe):
                raise ReaderError(f"unknown profile {profile!r}, or one of another universe")
            universe, strict_universe = found.universe, strict_universe or found.strict
        if universe and name != "daily_bars":
            raise ReaderError(f"a universe applies to daily_bars only, not to {name}")
        if adjust not in (None, "hfq", "qfq") or adjust and name == "index_bars":
            raise ReaderError(f"{name} cannot be adjusted by {adjust!r}")
        d, read = dataset(name), lambda n, **scope: self.canonical(n, revision=pins.get(n), **scope)
        if d.pit:
            if as_of is None:
                raise ReaderError(f"{name} requires as_of")
            facts = self.scan(name, symbols=symbols, revision=pins.get(name))
            by_period = {"start": start, "end": end} if "report_period" in facts.columns else {}
            out = read_pit(facts, list(d.key), as_of, items, all_vintages, mode=pit_mode or "best_effort", legacy_cutoff=pit_mode is None, **by_period)
            out = out if by_period else lake.narrowed(out, d.partition, start, end, None)
        else:
            out = read(name, start=start, end=end, symbols=symbols)
            if universe:
                scope = {"start": start, "end": end, "symbols": symbols}
                out = apply_universe(out, read("instruments"), read("trading_status", **scope), universe, strict_universe)
            if adjust and name in ADJUSTABLE:
                factors = read("adj_factors", start=start, end=end, symbols=symbols)
                out = A.hfq(out, factors, strict_adj) if adjust == "hfq" else A.forward_in_scope(out, factors, strict_adj)
        order = contract_order(out, d.partition) if ordered else []
        return out.orderBy(*order) if order else out

