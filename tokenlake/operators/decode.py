"""Raw log guards, block-time join and transfer decode (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hexcodec as H
from . import dedup as DD
from ..functions import uint256 as U
from ..schemas import (
    BLOCK_BUCKET_SIZE,
    EVENT_SIGNATURE,
    REJECT_DATA_LENGTH,
    REJECT_MISSING_BLOCK,
    REJECT_SIGNATURE,
    REJECT_TOPIC_COUNT,
    TRANSFER_COLUMNS,
    TRANSFER_TOPIC,
)


def topic0(topics: Column) -> Column:
    return F.lower(F.try_element_at(topics, F.lit(1)))


def scan_transfer_logs(raw: DataFrame, from_block: int | None = None, to_block: int | None = None) -> DataFrame:
    """Logs whose topic 0 is the Transfer hash, block in [from, to] (both inclusive).

    Landed logs carry ``topic0`` as a column, so both predicates reach Parquet.
    """
    t0 = F.col("topic0") if "topic0" in raw.columns else topic0(F.col("topics"))
    cond = t0 == TRANSFER_TOPIC
    if from_block is not None:
        cond = cond & (F.col("block_number") >= F.lit(from_block))
    if to_block is not None:
        cond = cond & (F.col("block_number") <= F.lit(to_block))
    return raw.where(cond)


def reject_reason(topics: Column, data: Column) -> Column:
    """The first failing guard (topic count, signature, data length) or NULL."""
    n = F.coalesce(F.size(topics), F.lit(0))
    t0 = topic0(topics)
    return (
        F.when(n != 3, F.lit(REJECT_TOPIC_COUNT))
        .when(t0.isNull() | (t0 != TRANSFER_TOPIC), F.lit(REJECT_SIGNATURE))
        .when(F.coalesce(H.hex_length(data), F.lit(0)) != 64, F.lit(REJECT_DATA_LENGTH))
    )


def classify(raw: DataFrame) -> DataFrame:
    return raw.withColumn("reject_reason", reject_reason(F.col("topics"), F.col("data")))


def one_header_per_block(blocks: DataFrame) -> DataFrame:
    """Headers reduced to one per block, so J1 stays N:1 even if a header was delivered twice.

    Equal repeats collapse; a block whose headers disagree has no time (NULL) and is treated like a block
    whose header is missing. A partial aggregate, small next to the logs.
    """
    lo, hi = F.min("block_time"), F.max("block_time")
    return blocks.groupBy("block_number").agg(F.when(lo == hi, lo).alias("block_time"))


def attach_block_time(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every log gets its block's time (N:1 equi-join on block_number); the join's kind is left to AQE.

    Logs without a header get reject reason ``missing_block`` unless a guard rejects them already;
    their ``block_time`` is NULL, which is what ``require_headers`` and ingestion look at.
    """
    j = logs.join(one_header_per_block(blocks), "block_number", "left")
    if "reject_reason" in j.columns:
        reason = F.coalesce(
            F.col("reject_reason"),
            F.when(F.col("block_time").isNull(), F.lit(REJECT_MISSING_BLOCK)),
        )
        j = j.withColumn("reject_reason", reason)
    return j


class MissingHeaders(RuntimeError):
    """Transfer logs whose block header is not known, or known with different times."""


def require_headers(logs: DataFrame, blocks: DataFrame) -> None:
    """Raises MissingHeaders if a log with the Transfer topic has no header, whatever the guards say of it."""
    missing = scan_transfer_logs(logs).select("block_number").distinct().join(blocks, "block_number", "left_anti")
    first = missing.agg(F.min("block_number").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if first.n:
        raise MissingHeaders(f"{first.n} blocks without a header, the first is {first.b}")


def record_columns(logs: DataFrame, keep_reason: bool = False) -> DataFrame:
    """P5-P7 (no amount arithmetic): key, chain position, addresses and value hex.

    Enough for first-wins dedup; ``decode_amounts`` adds the amounts.
    """
    cols = [
        F.lower(F.col("address")).alias("token"),
        H.topic_address(F.try_element_at(F.col("topics"), F.lit(2))).alias("from"),
        H.topic_address(F.try_element_at(F.col("topics"), F.lit(3))).alias("to"),
        F.lower(H.hex_body(F.col("data"))).alias("value_hex"),
        F.col("block_number"),
        F.lower(F.col("tx_hash")).alias("tx_hash"),
        F.col("tx_index"),
        F.col("log_index"),
    ]
    if "block_time" in logs.columns:
        cols.append(F.timestamp_seconds(F.col("block_time")).alias("timestamp"))
    if "arrival" in logs.columns:
        cols.append(F.col("arrival"))
    if keep_reason:
        cols.append(F.col("reject_reason"))
    return logs.select(*cols)


def decode_amounts(records: DataFrame) -> DataFrame:
    """P8-P14 on ``record_columns`` output: exact amounts, text, Decimal128 parity, time."""
    d = records.withColumn("event_signature", F.lit(EVENT_SIGNATURE))
    d = U.with_value_parts(d, "value_hex")
    d = d.withColumn("value_string", U.parts_to_string(F.col("value_parts")))
    d = d.withColumn("dec128_ok", U.dec128_ok(F.col("value_string")))
    d = d.withColumns(
        {
            "value_dec128": U.value_dec128(F.col("value_string"), F.col("dec128_ok")),
            "value_decimal": U.scaled_double(F.col("value_string")),
            "created_at": F.current_timestamp(),
            "block_bucket": F.expr(f"block_number div {BLOCK_BUCKET_SIZE}"),
        }
    )
    return d.select(*TRANSFER_COLUMNS)


def decode_logs(raw: DataFrame, blocks: DataFrame, first_wins: bool = False) -> tuple[DataFrame, DataFrame]:
    """Full decode: (transfers, rejects). Rejects keep the raw columns and a reason.

    ``first_wins`` dedups (D1) on the record columns before the amount arithmetic,
    so only the winners are decoded and the shuffle carries narrow rows.
    """
    timed = attach_block_time(classify(raw), blocks)
    accepted = timed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = timed.where(F.col("reject_reason").isNotNull())
    records = record_columns(accepted)
    if first_wins:
        records = DD.dedup_transfers(records)
    return decode_amounts(records), rejects


def transfers_from_raw(raw: DataFrame, blocks: DataFrame, first_wins: bool = False) -> DataFrame:
    """Accepted, decoded transfers; guards run before the join so rejects never shuffle.

    ``first_wins`` dedups (D1) before the amount arithmetic, as in ``decode_logs``.
    """
    accepted = classify(raw).where(F.col("reject_reason").isNull()).drop("reject_reason")
    timed = attach_block_time(accepted, blocks)
    records = record_columns(timed.where(F.col("block_time").isNotNull()))
    if first_wins:
        records = DD.dedup_transfers(records)
    return decode_amounts(records)
