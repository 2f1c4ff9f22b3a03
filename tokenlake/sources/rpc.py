"""Readers for node exports in JSON-RPC shape (``eth_getLogs`` results, block headers).

A log object carries hex quantities (``"blockNumber": "0x1a4"``) and camel-case
names; this maps them to the raw-log schema with built-in expressions (explicit
schema, no inference, nothing per row in Python). Removed (reorged-out) logs are
kept as delivered: the reference does not read the flag either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RPC_LOG_SCHEMA = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("blockNumber", T.StringType()),
        T.StructField("transactionHash", T.StringType()),
        T.StructField("transactionIndex", T.StringType()),
        T.StructField("logIndex", T.StringType()),
        T.StructField("removed", T.BooleanType()),
    ]
)

RPC_HEADER_SCHEMA = T.StructType(
    [T.StructField("number", T.StringType()), T.StructField("timestamp", T.StringType())]
)


def hex_quantity(c: Column) -> Column:
    """``0x``-prefixed hex quantity to BIGINT (NULL when absent)."""
    body = F.when(c.startswith("0x") | c.startswith("0X"), F.substring(c, 3, 1 << 30)).otherwise(c)
    return F.conv(body, 16, 10).cast("bigint")


def logs_from_rpc(rpc: DataFrame) -> DataFrame:
    return rpc.select(
        "address",
        "topics",
        "data",
        hex_quantity(F.col("blockNumber")).alias("block_number"),
        F.col("transactionHash").alias("tx_hash"),
        hex_quantity(F.col("transactionIndex")).cast("int").alias("tx_index"),
        hex_quantity(F.col("logIndex")).cast("int").alias("log_index"),
    )


def read_rpc_logs(spark: SparkSession, path: str) -> DataFrame:
    """S1 over JSON lines of ``eth_getLogs`` objects."""
    return logs_from_rpc(spark.read.schema(RPC_LOG_SCHEMA).json(path))


def stream_rpc_logs(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """S5 over JSON lines of ``eth_getLogs`` objects: new files as a stream, for ``ingest.stream_ingest``."""
    return logs_from_rpc(spark.readStream.schema(RPC_LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(path))


def read_rpc_headers(spark: SparkSession, path: str) -> DataFrame:
    """S2 over JSON lines of block headers (``number``, ``timestamp`` as hex quantities)."""
    h = spark.read.schema(RPC_HEADER_SCHEMA).json(path)
    return h.select(
        hex_quantity(F.col("number")).alias("block_number"), hex_quantity(F.col("timestamp")).alias("block_time")
    )


def to_rpc_logs(raw_logs: DataFrame) -> DataFrame:
    """The inverse mapping, to write raw logs as a node would export them."""
    q = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("bigint"))))
    return raw_logs.select(
        "address",
        "topics",
        "data",
        q("block_number").alias("blockNumber"),
        F.col("tx_hash").alias("transactionHash"),
        q("tx_index").alias("transactionIndex"),
        q("log_index").alias("logIndex"),
        F.lit(False).alias("removed"),
    )


def to_rpc_headers(blocks: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c))))
    return blocks.select(q("block_number").alias("number"), q("block_time").alias("timestamp"))
