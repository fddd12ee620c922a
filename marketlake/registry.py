"""The registered datasets: layer, tier, primary key, partitioning, columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROVENANCE = "source STRING, data_version STRING, fetched_at TIMESTAMP"


@dataclass(frozen=True)
class Dataset:
    name: str
    layer: str
    tier: str
    key: tuple[str, ...]
    partition: str
    granularity: str
    columns: str

    @property
    def pit(self) -> bool:
        return self.name in PIT

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(f"{self.columns}, {PROVENANCE}")

    def empty(self, spark: SparkSession) -> DataFrame:
        """The typed view of a dataset that has no files yet."""
        return spark.createDataFrame([], self.schema)


#: Read with an as-of date.
PIT = frozenset({"announcement_index", "financial_statement_items", "share_structure", "shareholder_counts", "top_holders"})

# Name | layer | tier | primary key | partition column | granularity | columns.
_TABLE = """
instruments | curated | L0 | symbol |  |  | symbol STRING, name STRING, exchange STRING, asset_type STRING, list_date DATE, delist_date DATE, prev_symbol STRING
trading_calendar | curated | L0 | trade_date | trade_date | year | trade_date DATE, is_trading BOOLEAN
trading_status | curated | L0 | symbol,trade_date | trade_date | month | symbol STRING, trade_date DATE, is_trading BOOLEAN, status STRING, risk_warning BOOLEAN
daily_bars | curated | L1 | symbol,trade_date | trade_date | day | symbol STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE
index_bars | curated | L1 | symbol,trade_date,frequency | trade_date | year | symbol STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE, frequency STRING
minute_bars | curated | L1 | symbol,trade_date,bar_time,frequency | trade_date | day | symbol STRING, trade_date DATE, bar_time TIMESTAMP_NTZ, frequency STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE
minute_bars_5m | curated | L1 | symbol,trade_date,bar_time,frequency | trade_date | day | symbol STRING, trade_date DATE, bar_time TIMESTAMP_NTZ, frequency STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE
trade_ticks | curated | L1 | symbol,trade_date,tick_seq | trade_date | day | symbol STRING, trade_date DATE, tick_seq INT, trade_time TIMESTAMP_NTZ, price DOUBLE, volume BIGINT, direction STRING
commodity_bars | curated | L1 | symbol,trade_date | trade_date | year | symbol STRING, name STRING, exchange STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE, open_interest DOUBLE
corporate_actions | curated | L2 | symbol,ex_date,action_type | ex_date | year | symbol STRING, ex_date DATE, action_type STRING, cash_dividend DOUBLE, bonus_ratio DOUBLE, transfer_ratio DOUBLE, allotment_ratio DOUBLE, allotment_price DOUBLE
announcement_index | curated | L2 | announcement_id | announce_date | day | announcement_id STRING, symbol STRING, title STRING, announce_date DATE, category STRING, url STRING
earnings_disclosure_schedule | curated | L2 | symbol,report_period | report_period | quarter | symbol STRING, report_period STRING, scheduled_date DATE, first_scheduled_date DATE, actual_date DATE
financial_statement_items | curated | L3 | symbol,report_period,statement_type,item_code,announce_date | report_period | quarter | symbol STRING, report_period STRING, statement_type STRING, item_code STRING, item_value DOUBLE, announce_date DATE
share_structure | curated | L3 | symbol,change_date,announce_date | change_date | year | symbol STRING, change_date DATE, total_shares DOUBLE, float_shares DOUBLE, restricted_shares DOUBLE, free_float_shares DOUBLE, change_reason STRING, announce_date DATE
shareholder_counts | curated | L3 | symbol,count_date,announce_date | count_date | year | symbol STRING, count_date DATE, holder_count DOUBLE, holder_count_change_pct DOUBLE, avg_float_shares DOUBLE, avg_holding_value DOUBLE, announce_date DATE
top_holders | curated | L3 | symbol,record_date,holder_scope,holder_rank,holder_name,announce_date | record_date | year | symbol STRING, record_date DATE, holder_scope STRING, holder_rank INT, holder_name STRING, holding_shares DOUBLE, holding_pct DOUBLE, is_institution BOOLEAN, holder_type STRING, announce_date DATE
valuation_metrics | curated | L3 | symbol,trade_date | trade_date | day | symbol STRING, trade_date DATE, pe_ttm DOUBLE, pb DOUBLE, ps_ttm DOUBLE, total_mv DOUBLE, float_mv DOUBLE
analyst_consensus | curated | L3 | symbol,forecast_date | forecast_date | day | symbol STRING, forecast_date DATE, forecast_year BIGINT, eps_forecast DOUBLE, pe_forecast DOUBLE, target_price DOUBLE, rating STRING, analyst_count BIGINT
fund_flow | curated | L4 | symbol,trade_date | trade_date | day | symbol STRING, trade_date DATE, main_net_inflow DOUBLE, super_large_net_inflow DOUBLE, large_net_inflow DOUBLE, medium_net_inflow DOUBLE, small_net_inflow DOUBLE
margin_trading | curated | L4 | symbol,trade_date | trade_date | day | symbol STRING, trade_date DATE, margin_balance DOUBLE, margin_buy DOUBLE, short_balance DOUBLE, short_sell_volume DOUBLE
northbound_holdings | curated | L4 | symbol,trade_date,channel | trade_date | day | symbol STRING, trade_date DATE, channel STRING, holding_shares DOUBLE, holding_mv DOUBLE, holding_ratio DOUBLE
northbound_flows | curated | L4 | trade_date,channel | trade_date | year | trade_date DATE, channel STRING, net_buy DOUBLE, buy_amount DOUBLE, sell_amount DOUBLE
dragon_tiger | curated | L4 | symbol,trade_date,reason | trade_date | month | symbol STRING, trade_date DATE, reason STRING, buy_amount DOUBLE, sell_amount DOUBLE, net_amount DOUBLE
block_trades | curated | L4 | symbol,trade_date,price,volume | trade_date | month | symbol STRING, trade_date DATE, price DOUBLE, volume DOUBLE, amount DOUBLE, premium_ratio DOUBLE
institutional_holdings | curated | L4 | symbol,holder_type,report_period | report_period | quarter | symbol STRING, holder_type STRING, report_period STRING, holding_shares DOUBLE, holding_ratio DOUBLE, holding_mv DOUBLE
sector_members | curated | L5 | symbol,sector_code,as_of_date | as_of_date | day | symbol STRING, sector_code STRING, sector_name STRING, as_of_date DATE
index_constituents | curated | L5 | index_symbol,symbol,as_of_date | as_of_date | month | index_symbol STRING, symbol STRING, as_of_date DATE, weight DOUBLE
industry_members | curated | L5 | symbol,classification_system,as_of_date | as_of_date | day | symbol STRING, classification_system STRING, industry_code STRING, industry_name STRING, as_of_date DATE
macro_indicators | curated | L6 | indicator_id,obs_date | obs_date | year | indicator_id STRING, obs_date DATE, value DOUBLE, frequency STRING
market_breadth | curated | L6 | trade_date,metric_id | trade_date | year | trade_date DATE, metric_id STRING, value DOUBLE
sentiment_scores | curated | L7 | symbol,trade_date,score_channel | trade_date | month | symbol STRING, trade_date DATE, score_channel STRING, sentiment_score DOUBLE, headline_count BIGINT
hot_rank | curated | L7 | symbol,trade_date | trade_date | month | symbol STRING, trade_date DATE, rank BIGINT, rank_change BIGINT, hist_rank BIGINT
sector_bars | curated | L7 | sector_code,trade_date | trade_date | month | sector_code STRING, sector_name STRING, board_type STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE, change_pct DOUBLE
sector_fund_flow | curated | L7 | sector_code,trade_date | trade_date | month | sector_code STRING, sector_name STRING, board_type STRING, trade_date DATE, main_net_inflow DOUBLE, change_pct DOUBLE, turnover_pct DOUBLE
news_headlines | curated | L7 | news_id | publish_date | month | news_id STRING, publish_date DATE, publish_time STRING, title STRING, summary STRING, related_symbols STRING, channel STRING
flash_news_wire | curated | L7 | wire_id,wire_source | publish_date | month | wire_id STRING, wire_source STRING, item_hash STRING, publish_date DATE, publish_time STRING, title STRING, summary STRING, related_symbols STRING, importance TINYINT, channel STRING
economic_calendar | curated | L7 | event_id | event_date | year | event_id STRING, event_date DATE, event_time STRING, country STRING, indicator STRING, importance TINYINT, forecast DOUBLE, previous DOUBLE, actual DOUBLE, unit STRING
share_unlock_schedule | curated | L8 | symbol,unlock_date | unlock_date | year | symbol STRING, unlock_date DATE, unlock_shares DOUBLE, unlock_ratio DOUBLE, unlock_type STRING
regulatory_events | curated | L8 | event_id | event_date | year | event_id STRING, symbol STRING, event_date DATE, event_type STRING, title STRING
adj_factors | derived | L1 | symbol,trade_date,adjust_type | trade_date | day | symbol STRING, trade_date DATE, adjust_type STRING, factor DOUBLE
industry_index | derived | L5 | trade_date,industry_code,level,weighting | trade_date | year | trade_date DATE, industry_code STRING, level STRING, weighting STRING, ret DOUBLE, n_members BIGINT, n_priced BIGINT, n_excluded BIGINT, amount DOUBLE
delisting_events | derived | L1 | symbol |  |  | symbol STRING, first_trade_date DATE, last_trade_date DATE, ending_pattern STRING, final_close DOUBLE, halt_gap_days BIGINT, worst_final_return DOUBLE, final_window_return DOUBLE, bars BIGINT
"""


def _parse(line: str) -> Dataset:
    name, layer, tier, key, partition, granularity, columns = (x.strip() for x in line.split("|"))
    return Dataset(name, layer, tier, tuple(key.split(",")), partition, granularity, columns)


DATASETS = {d.name: d for d in map(_parse, _TABLE.strip().splitlines())}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset: {name}")
    return DATASETS[name]


CONTRACT = "dataset string, column string, type string, key_position int, pit boolean, storage string"


def contracts(spark: SparkSession) -> DataFrame:
    """One row per dataset and column: key position, whether reads need an as-of date, partitioning, and a fingerprint of the dataset's contract."""
    rows = [(d.name, f.name, f.dataType.simpleString(), d.key.index(f.name) if f.name in d.key else None, d.pit, f"{d.partition}/{d.granularity}") for d in DATASETS.values() for f in d.schema]
    df = spark.createDataFrame(rows, CONTRACT)
    prints = df.groupBy("dataset").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "column", "type", "key_position"))), ","), 256).alias("fingerprint"))
    return df.join(prints, "dataset")


def described(df: DataFrame, name: str) -> DataFrame:
    """The contract rows that a table shows by itself: its columns and types, with the key and the rest of the registered contract."""
    d = dataset(name)
    rows = [(name, f.name, f.dataType.simpleString(), d.key.index(f.name) if f.name in d.key else None, d.pit, f"{d.partition}/{d.granularity}") for f in df.schema]
    return df.sparkSession.createDataFrame(rows, CONTRACT)


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two contract tables."""
    o = old.select("dataset", "column", F.col("type").alias("old_type"))
    n = new.select("dataset", "column", F.col("type").alias("new_type"))
    kind = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped")
    return o.join(n, ["dataset", "column"], "full_outer").withColumn("change", kind).where("change IS NOT NULL")


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two contract tables, as (dataset, column, kind, old, new, breaking).

    New datasets and new columns outside the key are compatible; all else breaks readers: datasets or columns that went, other types, another key,
    another meaning of reads (as-of date) or of storage (partitioning). A dataset that came or went is one row, not one per column.
    """
    whole = lambda df, side: df.groupBy("dataset").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column")))), lambda k: k["column"]), ",").alias(f"{side}_key"),
        F.bool_or("pit").cast("string").alias(f"{side}_pit"), F.max("storage").alias(f"{side}_storage"),
    )
    sets = whole(old, "old").join(whole(new, "new"), "dataset", "full_outer")
    none = F.lit(None).cast("string")
    came, went = F.col("old_key").isNull(), F.col("new_key").isNull()
    row = lambda kind, a, b, breaking: F.struct(none.alias("column"), F.lit(kind).alias("kind"), a.alias("old"), b.alias("new"), F.lit(breaking).alias("breaking"))
    both = [F.when(~came & ~went & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), row(f"{c}_changed", F.col(f"old_{c}"), F.col(f"new_{c}"), True)) for c in ("key", "pit", "storage")]
    found = F.array(F.when(went, row("dataset_removed", F.col("old_key"), none, True)), F.when(came, row("dataset_added", none, F.col("new_key"), False)), *both)
    of_sets = sets.select("dataset", F.inline(F.array_compact(found)))
    shared = sets.where(~came & ~went).select("dataset")
    keyed = new.where("key_position IS NOT NULL").select("dataset", "column", F.lit(True).alias("in_key"))
    columns = contract_diff(old, new).join(shared, "dataset", "left_semi").join(keyed, ["dataset", "column"], "left")
    breaking = (F.col("change") != "added") | F.coalesce("in_key", F.lit(False))
    of_columns = columns.select("dataset", "column", F.concat(F.lit("column_"), "change").alias("kind"), F.col("old_type").alias("old"), F.col("new_type").alias("new"), breaking.alias("breaking"))
    return of_columns.unionByName(of_sets.select(*of_columns.columns))


def affected(changes: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Adds to each change the stored rows that it touches: those with a value in the column, or all of the dataset; one pass over each table."""
    seen = None
    for name, df in stored.items():
        counts = [F.struct(F.lit(None).cast("string").alias("_column"), F.count(F.lit(1)).alias("n_rows")), *(F.struct(F.lit(c).alias("_column"), F.count(F.col(c)).alias("n_rows")) for c in df.columns)]
        one = df.agg(F.array(*counts).alias("c")).select(F.lit(name).alias("_dataset"), F.inline("c"))
        seen = one if seen is None else seen.unionByName(one)
    hit = (F.col("dataset") == F.col("_dataset")) & F.col("column").eqNullSafe(F.col("_column"))
    return changes.join(F.broadcast(seen), hit, "left").drop("_dataset", "_column")


def profile(df: DataFrame, name: str) -> DataFrame:
    """A table against its contract, one row per contract column: key position, rows, nulls, and what is wrong with it (null: nothing)."""
    d, have = dataset(name), {f.name: f.dataType.simpleString() for f in df.schema}
    counts = [F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), (F.count_if(F.col(f.name).isNull()) if f.name in have else F.count(F.lit(1))).alias("n_null")) for f in d.schema]
    seen = df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    rows = [(f.name, d.key.index(f.name) if f.name in d.key else None, f.dataType.simpleString(), have.get(f.name)) for f in d.schema]
    told = df.sparkSession.createDataFrame(rows, "column string, key_position int, type string, found string")
    wrong = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("type"), "retyped").when(F.col("key_position").isNotNull() & (F.col("n_null") > 0), "null_key")
    return seen.join(F.broadcast(told), "column").select(F.lit(name).alias("dataset"), "column", "key_position", "n_rows", "n_null", wrong.alias("finding"))


def with_provenance(df: DataFrame, source: str, data_version: str) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "data_version": F.lit(data_version), "fetched_at": F.current_timestamp()})
