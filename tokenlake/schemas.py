"""Schemas and fixed values of the transfer data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's for right results:
# keccak256("Transfer(address,address,uint256)"), the only accepted topic 0,
# and the event tag written to every stored transfer.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
EVENT_SIGNATURE = "Transfer"
# Listing limits: default page 100, largest page 1000.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
# Feed replay buffer for late subscribers and RPC latency histogram bounds (seconds).
FEED_BUFFER = 1024
RPC_DURATION_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
# Batch-duration histogram bounds (seconds).
BATCH_DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# Circuit breaker: consecutive failures that open it.
FAILURE_THRESHOLD = 5
# Ingestion: blocks per batch by default; poll interval.
DEFAULT_BATCH_BLOCKS = 10
POLL_INTERVAL = "12 seconds"
# Keys of a transfer in the JSON feed, in order.
FEED_JSON_KEYS = [
    "event_signature", "token", "from", "to", "value", "value_string", "value_decimal", "block_number", "tx_hash",
    "tx_index", "log_index", "timestamp", "created_at",
]
# Decimal128 keeps 34 significant digits; every token is read with 18 decimals.
DECIMAL128_DIGITS = 34
TOKEN_DECIMALS = 18

# Store layout: blocks per partition directory of the transfer store.
BLOCK_BUCKET_SIZE = 100_000

# Reject reasons, in the order the guards are checked.
REJECT_TOPIC_COUNT = "topic_count"
REJECT_SIGNATURE = "signature"
REJECT_DATA_LENGTH = "data_length"
REJECT_MISSING_BLOCK = "missing_block"

RAW_LOG_SCHEMA = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("tx_index", T.IntegerType()),
        T.StructField("log_index", T.IntegerType()),
    ]
)

# Optional delivery position of a log within its transaction (derived logs carry
# it; node exports do not).
ARRIVAL_TYPE = T.IntegerType()
RAW_LOG_WITH_ARRIVAL_SCHEMA = T.StructType(RAW_LOG_SCHEMA.fields + [T.StructField("arrival", ARRIVAL_TYPE)])

BLOCK_SCHEMA = T.StructType(
    [T.StructField("block_number", T.LongType()), T.StructField("block_time", T.LongType())]
)

VALUE_PARTS_TYPE = T.StructType([T.StructField(f"c{j}", T.LongType()) for j in range(9)])

TRANSFER_COLUMNS = [
    "event_signature",
    "token",
    "from",
    "to",
    "value_hex",
    "value_parts",
    "value_string",
    "value_dec128",
    "dec128_ok",
    "value_decimal",
    "block_number",
    "tx_hash",
    "tx_index",
    "log_index",
    "timestamp",
    "created_at",
    "block_bucket",
]

PROCESSED_BLOCK_SCHEMA = T.StructType(
    [T.StructField("block_number", T.LongType()), T.StructField("processed_at", T.TimestampType())]
)

CALL_LOG_SCHEMA = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("height", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
