"""Ingestion: batch ranges (R2), resume (R3), one range (R1), stream (S5), 24 h tx dedup.

Ticks, backfills and streams share ``ingest_logs``: scan by topic (S1), join block times (J1), count (O1),
decode, store (insert-ignore) with the progress mark. The log entry comes last, so a batch is
effectively once even when retried. A header that is missing fails the batch, as in the reference, and
nothing is marked; with ``missing="quarantine"`` such logs are kept aside and progress stops before them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import dedup as DD
from ..operators.store import ConcurrentCommit, TransferStore, bucket_mask, buckets_of
from ..schemas import (
    DEFAULT_BATCH_BLOCKS,
    POLL_INTERVAL,
    RAW_LOG_SCHEMA,
    REJECT_DATA_LENGTH,
    REJECT_MISSING_BLOCK,
    REJECT_SIGNATURE,
    REJECT_TOPIC_COUNT,
)

#: block headers, or how to read them anew: a frame keeps the file list it was made with
Headers = DataFrame | Callable[[], DataFrame]


def headers_now(blocks: Headers) -> DataFrame:
    return blocks() if callable(blocks) else blocks


# ---------------------------------------------------------------- ranges


def resume_from(last_processed: int, start_block: int) -> int:
    """Last + 1 when something was processed (last > 0), else the start block."""
    return last_processed + 1 if last_processed > 0 else start_block


def next_range(from_block: int, head: int, batch_blocks: int = DEFAULT_BATCH_BLOCKS) -> tuple[int, int] | None:
    """R2: [from, min(from + size - 1, head)], or None (no-op) when from > head."""
    if from_block > head:
        return None
    return from_block, min(from_block + batch_blocks - 1, head)


def chain_head(blocks: DataFrame) -> int:
    """S3: latest known block (a scalar, like the node's head lookup); 0 when empty."""
    v = blocks.agg(F.max("block_number").alias("head")).first()["head"]
    return int(v) if v is not None else 0


def batch_ranges(spark: SparkSession, start_block: int, head: int, batch_blocks: int) -> DataFrame:
    """R2 for a whole backfill: every range [from, min(from + size - 1, head)], generated distributed."""
    starts = spark.range(start_block, head + 1, batch_blocks).withColumnRenamed("id", "from_block")
    return starts.select("from_block", F.least(F.col("from_block") + batch_blocks - 1, F.lit(head)).alias("to_block"))


def resume_range(progress: DataFrame, head: DataFrame, start_block: int, batch_blocks: int) -> DataFrame:
    """R3 + R2 as one row: from_block, to_block (NULL when there is nothing to do), noop."""
    last = progress.agg(F.coalesce(F.max("block_number"), F.lit(0).cast("bigint")).alias("last"))
    last = last.unionByName(head.select(F.lit(None).cast("bigint").alias("last"), "head"), allowMissingColumns=True)
    one = last.agg(F.max("last").alias("last"), F.max("head").alias("head"))
    frm = F.when(F.col("last") > 0, F.col("last") + 1).otherwise(F.lit(start_block).cast("bigint"))
    one = one.select(frm.alias("from_block"), "head")
    noop = F.col("from_block") > F.col("head")
    return one.select(
        "from_block",
        F.when(noop, F.lit(None).cast("bigint"))
        .otherwise(F.least(F.col("from_block") + batch_blocks - 1, F.col("head")))
        .alias("to_block"),
        noop.alias("noop"),
    )


# ---------------------------------------------------------------- counters (O1)


def _reason_counts() -> list:
    r = F.col("reject_reason")
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(r == REJECT_TOPIC_COUNT).alias("rejected_topic_count"),
        F.count_if(r == REJECT_SIGNATURE).alias("rejected_signature"),
        F.count_if(r == REJECT_DATA_LENGTH).alias("rejected_data_length"),
        F.count_if(r == REJECT_MISSING_BLOCK).alias("missing_block"),
        F.count_if(r.isNull()).alias("accepted"),
    ]


def batch_counters() -> list:
    """O1 for one batch as aggregates over its classified records: rows read, rejects by reason, block bounds, key buckets."""
    return [
        *_reason_counts(),
        F.min("block_number").alias("from_block"),
        F.max("block_number").alias("to_block"),
        bucket_mask(F.col("tx_hash")).alias("buckets"),
    ]


def counters_by_range(raw_logs: DataFrame, blocks: DataFrame, start_block: int, head: int,
                      batch_blocks: int) -> DataFrame:
    """O1 for a backfill run in ranges of ``batch_blocks``: one batch-log row per range.

    One scan and one header join for all ranges: rejects come from the guards, ``inserted`` from the
    first-wins winners (ranges run in block order, so a key is inserted by the range of its first
    occurrence), which are flagged in the same pass.
    """
    range_id = F.floor((F.col("block_number") - start_block) / batch_blocks).alias("range_id")
    logs = D.scan_transfer_logs(raw_logs, start_block, head)
    # the ordering columns are enough: no amount arithmetic
    rows = D.record_columns(D.attach_block_time(D.classify(logs), blocks), keep_reason=True)
    accepted = F.col("reject_reason").isNull()
    order = [F.col(c).asc_nulls_last() for c in DD.FIRST_WINS_ORDER if c in rows.columns]
    first = F.row_number().over(Window.partitionBy(*DD.KEY, accepted).orderBy(*order)) == 1
    flagged = rows.withColumn("first", accepted & first)
    per = flagged.groupBy(range_id).agg(*_reason_counts(), F.count_if(F.col("first")).alias("inserted"))
    cols = [c for c in per.columns if c != "range_id"]
    frm = F.col("range_id") * batch_blocks + start_block
    return per.select(
        frm.alias("from_block"),
        F.least(frm + batch_blocks - 1, F.lit(head)).alias("to_block"),
        *cols,
        (F.col("accepted") - F.col("inserted")).alias("duplicates"),
        F.lit("ok").alias("status"),
    )


# ---------------------------------------------------------------- one batch


def headers_between(blocks: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Headers of the blocks from first to last; the bounds reach the scan as pushed predicates."""
    return blocks.where(F.lit(False)) if first is None else blocks.where(F.col("block_number").between(first, last))


def headerless(records: DataFrame, headers: DataFrame) -> DataFrame:
    """One row: logs in blocks without a header (``headerless``), the first such block, those not rejected already (``lacking``).

    Only block numbers and reasons are read, counted by block before the join.
    """
    by_block = records.groupBy("block_number").agg(F.count("*").alias("n"), F.count_if(F.col("reject_reason").isNull()).alias("good"))
    known = D.one_header_per_block(headers).where("block_time IS NOT NULL")
    return by_block.join(known, "block_number", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("headerless"),
        F.min("block_number").alias("first_headerless"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("lacking"),
    )


def ingest_logs(
    store: TransferStore,
    logs: DataFrame,
    blocks: Headers,
    batch_id: str,
    covers: Callable[[dict], tuple[int, int] | None] = lambda counts: None,
    missing: str = "fail",
) -> int:
    """One batch through the whole path; returns rows inserted.

    The source is read once: its classified records (no amounts, no header) are staged, and the counters are
    observed while they are written. Everything else reads the staged records. Headers are read for the
    blocks between the batch's first and last only (S2), as a predicate on the scan. ``covers`` tells from the batch's counters which block range it ingests in full (K2). A failed
    attempt is recorded with its error type (O1) and raised again.
    """
    if missing not in ("fail", "quarantine"):
        raise ValueError(f"missing must be 'fail' or 'quarantine', got {missing!r}")
    if store.is_committed(batch_id):
        return 0
    log, staged = {"started": time.time()}, store.staging(f"records-{uuid.uuid4().hex}")
    try:
        transfer_logs, seen = D.scan_transfer_logs(logs), Observation(f"batch-{uuid.uuid4().hex}")
        records = D.record_columns(D.classify(transfer_logs), keep_reason=True)
        records.observe(seen, *batch_counters()).write.option("compression", "zstd").parquet(staged)
        records = store.spark.read.schema(records.schema).parquet(staged)
        log |= seen.get
        headers = headers_between(headers_now(blocks), log["from_block"], log["to_block"])
        log |= headerless(records, headers).first().asDict()
        log["missing_block"], log["accepted"] = log["lacking"], log["accepted"] - log["lacking"]
        covered, aside = covers(log), None
        if covered:
            log["from_block"], log["to_block"] = covered
        if log["headerless"]:
            if missing == "fail":
                raise D.MissingHeaders(f"{log['headerless']} logs without a block header, the first in block {log['first_headerless']}")
            aside = D.attach_block_time(transfer_logs, headers).where(F.col("block_time").isNull()).drop("block_time")
            stop = log["first_headerless"]  # NULL: a log without a block number, which lies in no range
            covered = covered and stop is not None and (covered[0], min(covered[1], stop - 1)) or None
        accepted = D.attach_block_time(records.where(F.col("reject_reason").isNull()).drop("reject_reason"), headers)
        timed = accepted.where(F.col("block_time").isNotNull()).withColumn("timestamp", F.timestamp_seconds("block_time")).drop("block_time")
        fresh = DD.dedup_transfers(timed)
        return store.insert_ignore(fresh, batch_id, covered, log=log, deduped=True, quarantine=aside, buckets=buckets_of(log["buckets"]))
    except ConcurrentCommit:
        raise  # not a failure of this batch: compare again with what is stored now
    except Exception as error:
        store.record_failure(batch_id, error, log)
        raise
    finally:
        store.fs.discard(staged)


def ingest_range(
    store: TransferStore,
    raw_logs: DataFrame,
    blocks: Headers,
    from_block: int,
    to_block: int,
    batch_id: str,
    missing: str = "fail",
) -> int:
    """R1 for one block range, which is marked as processed to its end, with logs or without."""
    logs = raw_logs.where(F.col("block_number").between(from_block, to_block))
    return ingest_logs(store, logs, blocks, batch_id, lambda _: (from_block, to_block), missing)


def slow_batches(batch_log: DataFrame, poll_interval_s: float = 12.0) -> DataFrame:
    """Flag batches that took longer than the poll interval; a batch log, or a stream's progress (``progress.read_progress``)."""
    bounds = [c for c in ("from_block", "to_block") if c in batch_log.columns]
    return batch_log.select("batch", *bounds, "duration_s", (F.col("duration_s") > poll_interval_s).alias("slow"))


def _attempt(kind: str, lo: int, hi: int) -> str:
    """A batch id of its own for every attempt: a range that is run again later may bring new rows."""
    return f"{kind}-{lo:012d}-{hi:012d}-{uuid.uuid4().hex[:12]}"


def poll_once(
    store: TransferStore,
    raw_logs: DataFrame,
    blocks: Headers,
    start_block: int,
    batch_blocks: int = DEFAULT_BATCH_BLOCKS,
    force_start: bool = False,
    missing: str = "fail",
    head: int | None = None,
) -> tuple[int, int] | None:
    """One ingestion tick as a batch job: resume (R3), range (R2), ingest.

    ``head`` is the chain head as the node reports it (S3), by default the latest known header; the head may be a
    block without logs or header. ``force_start`` takes the range from ``start_block`` whatever the progress says;
    ``forced_restart`` goes on from there to the head (R4). Returns the range ingested, or None when the
    head is below the next block (no-op: nothing written, no progress row).
    """
    if batch_blocks < 1:
        raise ValueError(f"batch_blocks must be at least 1, got {batch_blocks}")
    frm = start_block if force_start else resume_from(store.last_processed_block(start_block), start_block)
    rng = next_range(frm, chain_head(headers_now(blocks)) if head is None else head, batch_blocks)
    if rng is not None:
        ingest_range(store, raw_logs, blocks, *rng, _attempt("forced" if force_start else "tick", *rng), missing)
    return rng


def forced_restart(
    store: TransferStore,
    raw_logs: DataFrame,
    blocks: Headers,
    start_block: int,
    batch_blocks: int = DEFAULT_BATCH_BLOCKS,
    missing: str = "fail",
) -> list[tuple[int, int]]:
    """Every range from ``start_block`` to the head, whatever the progress says; insert-ignore absorbs the replay."""
    done: list[tuple[int, int]] = []
    while (rng := next_range(done[-1][1] + 1 if done else start_block, chain_head(headers_now(blocks)), batch_blocks)) is not None:
        ingest_range(store, raw_logs, blocks, *rng, _attempt("forced", *rng), missing)
        done.append(rng)
    return done


def backfill(
    store: TransferStore,
    raw_logs: DataFrame,
    blocks: Headers,
    from_block: int,
    to_block: int | None = None,
    run_id: str | None = None,
    missing: str = "fail",
) -> int:
    """A whole range as one batch: one shuffle for dedup, one anti-join, one write.

    ``to_block`` defaults to the chain head. With a ``run_id``, the same range of the same run is
    ingested once; without, every call is a run of its own.
    """
    end = to_block if to_block is not None else chain_head(headers_now(blocks))
    batch_id = f"{run_id}-{from_block:012d}-{end:012d}" if run_id else _attempt("backfill", from_block, end)
    return ingest_range(store, raw_logs, blocks, from_block, end, batch_id, missing)


# ---------------------------------------------------------------- stream


def stream_ingest(
    spark: SparkSession,
    input_dir: str,
    blocks: Headers,
    store: TransferStore,
    checkpoint: str,
    max_files_per_trigger: int = 1,
    available_now: bool = True,
    processing_time: str = POLL_INTERVAL,
    schema=RAW_LOG_SCHEMA,
    read_logs: Callable[[SparkSession, str, int], DataFrame] | None = None,
    start_block: int | None = None,
    missing: str = "fail",
):
    """S5 + R1: raw-log files as a stream, each micro-batch ingested in ``foreachBatch``.

    Exactly-once effect: the id of the query (kept in its checkpoint) and the micro-batch number name
    the batch; a replayed micro-batch finds its log entry and is skipped. Dedup state lives in the store,
    not in the stream (no unbounded ``dropDuplicates`` state). Headers are read anew in every micro-batch
    if ``blocks`` is a function; a missing one fails the query, which goes on from there when it is
    started again. ``read_logs`` (spark, path, files per trigger) gives other sources than Parquet, such as
    ``rpc.stream_rpc_logs``. With ``start_block``, files are taken to arrive in block order and
    each micro-batch marks progress from the last mark to its largest block; without it the stream marks
    nothing, since a late file may hold any block.
    """

    def covers(counts: dict) -> tuple[int, int] | None:
        if start_block is None or counts["to_block"] is None:
            return None
        return resume_from(store.last_processed_block(start_block), start_block), counts["to_block"]

    def one_batch(batch: DataFrame, batch_num: int) -> None:
        query = json.loads(store.fs.read_text(f"{checkpoint}/metadata"))["id"]
        ingest_logs(store, batch, blocks, f"{query}-{batch_num:010d}", covers, missing)

    if read_logs is not None:
        stream = read_logs(spark, input_dir, max_files_per_trigger)
    else:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(input_dir)
    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def dedup_tx_within(
    spark: SparkSession,
    input_dir: str,
    blocks: Headers,
    out_dir: str,
    checkpoint: str,
    horizon: str = "24 hours",
    max_files_per_trigger: int = 1,
):
    """R6 (opt-in): drop a transfer whose tx_hash was seen within ``horizon`` of event time.

    State is bounded by the watermark; what expires depends on micro-batch boundaries, so there is no batch
    equivalent (``chains.keep_chain`` and its stream depend on the data alone). A missing header fails the query.
    """
    stream = spark.readStream.schema(RAW_LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(input_dir)
    accepted = D.classify(stream).where(F.col("reject_reason").isNull()).drop("reject_reason")
    # a log without a header fails the query, which goes on from there when it is started again; none is dropped
    failed = F.raise_error(F.concat(F.lit("a log without a block header, block "), F.col("block_number"))).cast("bigint")
    timed = D.attach_block_time(accepted, headers_now(blocks)).withColumn("block_time", F.coalesce("block_time", failed))
    # amounts of the kept ones only, after the shuffle
    kept = D.record_columns(timed).withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["tx_hash"])
    out = D.decode_amounts(kept).select("tx_hash", "log_index", "block_number", "token", "from", "to", "value_string", "timestamp")
    return (
        out.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
