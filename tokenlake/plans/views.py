"""Shared inputs and result shapes of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as D
from ..sources import landing as L


def utc_ntz(name: str) -> Column:
    """A TIMESTAMP column as UTC wall-clock TIMESTAMP_NTZ, whatever the session time zone."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{name}`), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs derived from lineitem/orders, landed as block-sorted Parquet."""
    return L.landed_raw_logs(spark, sf_dir)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.landed_blocks(spark, sf_dir)


def decoded_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted logs, decoded, before dedup."""
    return D.transfers_from_raw(raw_logs(spark, sf_dir), blocks(spark, sf_dir))


def deduped_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 in one plan: first-wins dedup on the record columns, then the amounts."""
    return D.transfers_from_raw(raw_logs(spark, sf_dir), blocks(spark, sf_dir), first_wins=True)


def stored_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after a full backfill through the ingest path."""
    return L.backfilled_store(spark, sf_dir).read()


def transfer_view(df: DataFrame) -> DataFrame:
    """Transfer columns as compared with the oracles (no wall-clock column)."""
    return df.select(
        "event_signature",
        "token",
        "from",
        "to",
        "value_hex",
        "value_string",
        "value_decimal",
        "dec128_ok",
        F.col("value_dec128").cast("string").alias("value_dec128"),
        "block_number",
        "tx_hash",
        "tx_index",
        "log_index",
        utc_ntz("timestamp").alias("timestamp"),
    )


def aggregate_view(agg: DataFrame) -> DataFrame:
    """The aggregate response with ``time_range`` flattened."""
    flat = agg.select(
        "total_transfers",
        "total_value",
        "total_value_decimal",
        "unique_tokens",
        "unique_addresses",
        F.col("time_range.start").alias("__s"),
        F.col("time_range.end").alias("__e"),
    )
    return flat.select(
        "total_transfers",
        "total_value",
        "total_value_decimal",
        "unique_tokens",
        "unique_addresses",
        utc_ntz("__s").alias("time_start"),
        utc_ntz("__e").alias("time_end"),
    )
