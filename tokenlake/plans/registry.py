"""Registered queries: one Spark plan per inventory item, plus its DuckDB oracle.

Every query reads the given tables (or data Spark derives from them) in full.
Parameter values (an address, a block range, a page) are the feature being
tested, never a device to shrink the input.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import TransferQueryParams
from ..operators import callstats as CS
from ..operators import chains as CH
from ..operators import decode as D
from ..operators import dedup as DD
from ..operators import paging as PG
from ..operators import query as Q
from ..operators import requests as RQ
from ..operators import sketches as SK
from ..operators import store as ST
from ..schemas import BATCH_DURATION_BOUNDS, FEED_BUFFER, RPC_DURATION_BOUNDS, TRANSFER_TOPIC, VALUE_PARTS_TYPE
from ..session import tuned
from ..sources import fixtures as FX
from ..sources import landing as L
from ..streaming import ingest as I
from ..streaming import progress as PR
from . import oracle as O
from . import scenarios as SC
from . import views as V

# Parameters of the registered queries.
TOKEN = "0x" + "1".rjust(40, "0")  # token of l_partkey 1
SENDER = "0x" + "1f".rjust(40, "0")  # sender of l_suppkey 1 (1 * 31)
RECEIVER = "0x" + "1".rjust(40, "0")  # receiver of o_custkey 1
MIXED_CASE_TOKEN = "0x" + "A".rjust(40, "0")  # stored lower case: matches nothing
BLOCK_LO, BLOCK_HI = 100, 200
TIME_LO = datetime(1996, 1, 1, tzinfo=timezone.utc)
TIME_HI = datetime(1996, 12, 31, 23, 59, 59, tzinfo=timezone.utc)
STREAK_MIN = 3
AFTER_KEY = (1200, 3, "0x" + "8".rjust(64, "0"))
DEEP_RANGE_ROWS = 1000  # small, so that every level of counts is gone through on the given tables

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- sources, decode


def raw_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.scan_transfer_logs(V.raw_logs(spark, sf_dir))
    return s.select(
        "address",
        D.topic0(F.col("topics")).alias("topic0"),
        F.size("topics").alias("topic_count"),
        "data",
        "block_number",
        "tx_hash",
        "tx_index",
        "log_index",
    )


def chain_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks(spark, sf_dir).agg(F.max("block_number").alias("head"))


def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.classify(V.raw_logs(spark, sf_dir))
    return c.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def decode_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(V.decoded_transfers(spark, sf_dir))


def value_dec128(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.decoded_transfers(spark, sf_dir)
    return t.select(
        "tx_hash",
        "log_index",
        "value_string",
        "dec128_ok",
        F.col("value_dec128").cast("string").alias("value_dec128"),
    )


def join_block_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = D.attach_block_time(V.raw_logs(spark, sf_dir), V.blocks(spark, sf_dir))
    j = j.withColumn("timestamp", F.timestamp_seconds("block_time"))
    return j.select("tx_hash", "log_index", "block_number", "block_time", V.utc_ntz("timestamp").alias("timestamp"))


def rpc_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1/S2 over JSON-RPC exports: hex quantities mapped, then decode and dedup."""
    from ..sources import rpc as RPC

    logs_path, headers_path = SC.rpc_export(spark, sf_dir)
    logs = RPC.read_rpc_logs(spark, logs_path)
    headers = RPC.read_rpc_headers(spark, headers_path)
    return V.transfer_view(D.transfers_from_raw(logs, headers, first_wins=True))


def dedup_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(V.deduped_transfers(spark, sf_dir))


# ---------------------------------------------------------------- aggregates


def _aggregates(params: TransferQueryParams) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.aggregate_view(Q.aggregates(V.stored_transfers(spark, sf_dir), params))

    return q


def aggregates_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A6 from the stored summaries alone; distinct counts must lie within the sketches' error of the exact ones."""
    store, _ = SC.replay_store(spark, sf_dir)
    exact = Q.aggregates(store.read()).select("unique_tokens", "unique_addresses").first()
    close = lambda c: (F.abs(F.col(c) - exact[c]) <= SK.ERROR * exact[c] + 1).alias(c.removeprefix("unique_") + "_close")
    return V.aggregate_view(SK.aggregates(store)).select(
        "total_transfers", "total_value", "total_value_decimal", "time_start", "time_end", close("unique_tokens"), close("unique_addresses")
    )


def exact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.exact_total(V.stored_transfers(spark, sf_dir))


def legacy_value_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored up to block 1200 are legacy (text value only), later ones Decimal128."""
    t = V.stored_transfers(spark, sf_dir)
    legacy = F.col("block_number") <= 1200
    t = t.withColumns(
        {
            "dec128_ok": F.when(legacy, F.lit(None).cast("boolean")).otherwise(F.col("dec128_ok")),
            "value_parts": F.when(legacy, F.lit(None).cast(VALUE_PARTS_TYPE)).otherwise(F.col("value_parts")),
        }
    )
    a = Q.aggregates(t)
    return a.select("total_transfers", "total_value")


# ---------------------------------------------------------------- listing


def _listing(params: TransferQueryParams, paged: bool) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = V.stored_transfers(spark, sf_dir)
        out = Q.page(t, params) if paged else Q.filtered(t, params)
        return V.transfer_view(out)

    return q


def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_total(V.stored_transfers(spark, sf_dir), TransferQueryParams(start_block=1000))


def page_deep_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of the store, found by counted ranges."""
    t = V.stored_transfers(spark, sf_dir)
    total = Q.page_total(t, TransferQueryParams()).first().total
    return V.transfer_view(PG.page_deep(t, TransferQueryParams(offset=total // 2), range_rows=DEEP_RANGE_ROWS))


def page_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset paging: the page after a given listing key."""
    return V.transfer_view(Q.page_after(V.stored_transfers(spark, sf_dir), TransferQueryParams(), AFTER_KEY))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17/F1-F8/T1-T5 for every request derived from ``events``: totals and pages."""
    t = V.stored_transfers(spark, sf_dir)
    answers = RQ.answer(t, FX.requests(spark, sf_dir), ["block_number", "log_index", "tx_hash"])
    return answers.select("request_id", "error", "total", "limit", "offset", "position", "block_number", "log_index", "tx_hash")


# ---------------------------------------------------------------- sets


def address_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.address_universe(V.stored_transfers(spark, sf_dir))


def distinct_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.distinct_blocks(V.raw_logs(spark, sf_dir))


# ---------------------------------------------------------------- store, progress, stream

BATCH = 100  # blocks per batch in the range queries (the reference's largest batch)


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batch_id = SC.replay_store(spark, sf_dir)
    return V.transfer_view(store.read_batch(batch_id))


def processed_blocks_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the marks that two runs and a forced restart left, one row per block marked."""
    return SC.restarted_store(spark, sf_dir).progress().select("block_number")


def last_processed_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.L.backfilled_store(spark, sf_dir).contiguous()


def ingest_block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.batch_ranges(spark, 1, I.chain_head(V.blocks(spark, sf_dir)), BATCH)


def resume_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run's progress as stored, resumed with the next batch."""
    head = V.blocks(spark, sf_dir).agg(F.max("block_number").alias("head"))
    return I.resume_range(SC.first_run_store(spark, sf_dir).progress(), head, 1, BATCH)


def forced_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(SC.restarted_store(spark, sf_dir).read())


def backfill_extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(SC.extended_store(spark, sf_dir).read())


def stream_late_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(SC.late_header_store(spark, sf_dir).read())


def missing_header_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log with its place: stored as a transfer, or kept aside for want of a header."""
    store = SC.quarantine_store(spark, sf_dir)
    aside = store.quarantined(SC.L.LANDED_LOG_SCHEMA).select(F.lit("quarantined").alias("place"), "tx_hash", "log_index", "block_number")
    return store.read().select(F.lit("stored").alias("place"), "tx_hash", "log_index", "block_number").unionByName(aside)


def rpc_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(SC.rpc_streamed_store(spark, sf_dir).read())


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = V.blocks(spark, sf_dir)
    return I.counters_by_range(V.raw_logs(spark, sf_dir), blocks, 1, I.chain_head(blocks), BATCH)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfer_view(SC.streamed_store(spark, sf_dir).read())


def feed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a late subscriber gets: the oldest FEED_BUFFER published transfers, in commit order."""
    return SC.restarted_store(spark, sf_dir).feed_after().select("block_number", "log_index", "tx_hash")


def feed_after_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscriber comes back with the position of the last transfer of the snapshot."""
    store = SC.restarted_store(spark, sf_dir)
    last = store.feed_after().select(F.max(F.struct(*ST.FEED_ORDER)).alias("at")).first().at
    return store.feed_after(last and tuple(last)).select("block_number", "log_index", "tx_hash")


FEED_FIELDS = """event_signature string, token string, `from` string, `to` string, value string, value_string string,
  value_decimal double, block_number long, tx_hash string, tx_index int, log_index int, timestamp string"""


def transfer_feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines that a feed stream published, parsed back (all but the wall-clock ``created_at``)."""
    from ..streaming.feed import read_feed

    return read_feed(spark, SC.published_feed(spark, sf_dir)).select(F.from_json("json", FEED_FIELDS).alias("t")).select("t.*")


def stream_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 as recorded by the stream, one row per micro-batch; sums equal the backfill's."""
    log = SC.streamed_store(spark, sf_dir).batch_log()
    cols = ["rows_read", "rejected_topic_count", "rejected_signature", "rejected_data_length", "missing_block",
            "accepted", "inserted", "duplicates"]
    return log.agg(F.count(F.lit(1)).alias("batches"), *[F.sum(c).cast("bigint").alias(c) for c in cols])


def slow_batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6 over a batch log derived from ``events`` (duration from ``value``), so that the flag has an oracle."""
    events = FX.read_table(spark, sf_dir, "events")
    log = events.select(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("batch"), F.col("event_id").alias("from_block"),
                        (F.col("event_id") + 9).alias("to_block"), F.col("value").alias("duration_s"))
    return I.slow_batches(log)


def dedup_tx_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each transaction was kept; which of its logs comes first is up to the source's files."""
    return spark.read.parquet(SC.dedup_tx_output(spark, sf_dir)).groupBy("tx_hash").agg(F.count(F.lit(1)).alias("kept"))


def dedup_tx_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 as a function of the data: of each user's events those 24 h or more past the last kept one."""
    events = FX.read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return CH.keep_chain(events, "user_id", "ts", ["event_id"]).drop("__key", "__t")


def dedup_tx_chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over micro-batches, with the last kept times carried between them."""
    return spark.read.parquet(SC.chained_events(spark, sf_dir)).drop("batch")


def failure_streaks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 over eight micro-batches: streaks that span them are joined from the stored open runs."""
    return SC.streamed_streaks(spark, sf_dir, STREAK_MIN)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6 from the stream's own progress: micro-batches, rows read, and how many are flagged by a limit that each passes, and by one that none does."""
    progress = PR.read_progress(spark, SC.watched_stream(spark, sf_dir))
    flagged = lambda limit: F.count_if(F.col("duration_s") > limit)
    rows = F.count_if(F.col("input_rows") > 0)
    return progress.agg(F.count("*").alias("batches"), rows.alias("with_rows"), flagged(0.0).alias("over_0_s"), flagged(86400.0).alias("over_1_day"))


def batch_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: batch durations in the default bounds, over the batch log derived from ``events``."""
    events = FX.read_table(spark, sf_dir, "events")
    log = events.select(F.lit("ingest").alias("provider"), F.lit("batch").alias("method"), F.col("value").alias("duration_s"))
    return CS.duration_histogram(log, BATCH_DURATION_BOUNDS).select("le", "cumulative_count")


def call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.call_errors(FX.call_log(spark, sf_dir))


# ---------------------------------------------------------------- call log analytics


def call_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.call_counters(FX.call_log(spark, sf_dir))


def call_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.duration_histogram(FX.call_log(spark, sf_dir), RPC_DURATION_BOUNDS)


def call_duration_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.duration_sum(FX.call_log(spark, sf_dir))


def _streaks(threshold: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = CS.failure_streaks(FX.call_log(spark, sf_dir), threshold=threshold)
        return s

    return q


def block_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.block_height(FX.call_log(spark, sf_dir))


def _tuned(query: Query) -> Query:
    return lambda spark, sf_dir: query(tuned(spark, L.table_bytes(spark, sf_dir)), sf_dir)


def queries() -> dict[str, Query]:
    named = {
        "raw_log_scan": raw_log_scan,
        "chain_head": chain_head,
        "decode_rejects": decode_rejects,
        "decode_transfers": decode_transfers,
        "value_dec128": value_dec128,
        "join_block_time": join_block_time,
        "dedup_transfers": dedup_transfers,
        "rpc_json_decode": rpc_json_decode,
        "aggregates_all": _aggregates(TransferQueryParams()),
        "aggregates_token": _aggregates(TransferQueryParams(token=TOKEN)),
        "aggregates_blocks": _aggregates(TransferQueryParams(start_block=BLOCK_LO, end_block=BLOCK_HI)),
        "aggregates_time": _aggregates(TransferQueryParams(start_time=TIME_LO, end_time=TIME_HI)),
        "aggregates_empty": _aggregates(TransferQueryParams(token=MIXED_CASE_TOKEN)),
        "aggregates_sketched": aggregates_sketched,
        "exact_total": exact_total,
        "legacy_value_sum": legacy_value_sum,
        "filter_token": _listing(TransferQueryParams(token=TOKEN), paged=False),
        "filter_from": _listing(TransferQueryParams(from_=SENDER), paged=False),
        "filter_to": _listing(TransferQueryParams(to=RECEIVER), paged=False),
        "filter_block_range": _listing(TransferQueryParams(start_block=BLOCK_LO, end_block=BLOCK_HI), paged=False),
        "filter_time_range": _listing(TransferQueryParams(start_time=TIME_LO, end_time=TIME_HI), paged=False),
        "page_first": _listing(TransferQueryParams(), paged=True),
        "page_clamped": _listing(TransferQueryParams(start_block=BLOCK_LO, end_block=BLOCK_HI, limit=5000), paged=True),
        "page_offset": _listing(TransferQueryParams(limit=50, offset=250), paged=True),
        "page_deep_offset": page_deep_offset,
        "page_after_key": page_after_key,
        "page_total": page_total,
        "request_table": request_table,
        "address_universe": address_universe,
        "distinct_blocks": distinct_blocks,
        "insert_ignore": insert_ignore,
        "processed_blocks_upsert": processed_blocks_upsert,
        "last_processed_block": last_processed_block,
        "ingest_block_range": ingest_block_range,
        "resume_range": resume_range,
        "ingest_counters": ingest_counters,
        "stream_ingest": stream_ingest,
        "stream_late_headers": stream_late_headers,
        "missing_header_quarantine": missing_header_quarantine,
        "rpc_stream_ingest": rpc_stream_ingest,
        "forced_restart": forced_restart,
        "backfill_extends": backfill_extends,
        "feed_snapshot": feed_snapshot,
        "feed_after_position": feed_after_position,
        "transfer_feed_json": transfer_feed_json,
        "dedup_tx_24h": dedup_tx_24h,
        "dedup_tx_chain": dedup_tx_chain,
        "dedup_tx_chain_stream": dedup_tx_chain_stream,
        "stream_batch_log": stream_batch_log,
        "slow_batch_flags": slow_batch_flags,
        "batch_duration_histogram": batch_duration_histogram,
        "call_counters": call_counters,
        "call_errors": call_errors,
        "call_duration_histogram": call_duration_histogram,
        "call_duration_sum": call_duration_sum,
        "failure_streaks": _streaks(5),
        "failure_streaks_stream": failure_streaks_stream,
        "stream_progress": stream_progress,
        "failure_streaks_min3": _streaks(STREAK_MIN),
        "block_height": block_height,
    }
    return {name: _tuned(query) for name, query in named.items()}


# ---------------------------------------------------------------- oracles




def oracle_sql() -> dict[str, str]:
    wb = O.with_base
    t_lo = "TIMESTAMP '1996-01-01 00:00:00'"
    t_hi = "TIMESTAMP '1996-12-31 23:59:59'"
    wide_terms = [("n_wide", int(O.WIDE_VALUE))]
    hist_sql = (
        "WITH " + O.CALL_LOG_CTE.strip() + "\n"
        + "\nUNION ALL\n".join(
            f"SELECT provider, method, '{CS.le_label(b)}' AS le, count_if(duration_s <= {b}) AS cumulative_count "
            "FROM call_log GROUP BY provider, method"
            for b in RPC_DURATION_BOUNDS
        )
        + "\nUNION ALL\nSELECT provider, method, '+Inf' AS le, count(*) AS cumulative_count "
        "FROM call_log GROUP BY provider, method"
    )

    micro = f"CAST({SC.STREAM_FILES // SC.FILES_PER_TRIGGER} AS BIGINT)"
    # commits of the first run, the second run, and the forced restart, which brings the late blocks
    feed_sql = wb() + f"""SELECT block_number, log_index, tx_hash FROM transfers
ORDER BY CASE WHEN block_number % {SC.LATE} = 0 THEN 2000000 + (block_number - 1) // {2 * SC.TICK}
              WHEN block_number <= {SC.SPLIT_BLOCK} THEN (block_number - 1) // {SC.TICK} ELSE 1000000 END,
  block_number, log_index, tx_hash LIMIT {FEED_BUFFER}"""

    def streak_sql(threshold: int) -> str:
        return (
            "WITH " + O.CALL_LOG_CTE.strip() + """,
g AS (
  SELECT provider, ts, seq, ok,
         row_number() OVER (PARTITION BY provider ORDER BY ts, seq)
       - row_number() OVER (PARTITION BY provider, ok ORDER BY ts, seq) AS grp
  FROM call_log
),
runs AS (
  SELECT provider, min({'ts': ts, 'seq': seq}) AS s, max({'ts': ts, 'seq': seq}) AS e, count(*) AS length
  FROM g WHERE NOT ok GROUP BY provider, grp
)
SELECT provider, s.ts AS start_ts, s.seq AS start_seq, e.ts AS end_ts, e.seq AS end_seq, length
FROM runs WHERE length >= """
            + str(threshold)
        )

    return {
        "raw_log_scan": wb()
        + f"""SELECT '0x' || CASE WHEN pkey % 2 = 0 THEN lpad(hex(pkey), 40, '0')
                      ELSE lower(lpad(hex(pkey), 40, '0')) END AS address,
  '{TRANSFER_TOPIC}' AS topic0,
  CAST(CASE WHEN lnum = 7 THEN 4 ELSE 3 END AS INTEGER) AS topic_count,
  '0x' || CASE WHEN tax = 0.08 THEN substr(value_hex, 3) ELSE value_hex END AS data,
  block_number, tx_hash, tx_index, log_index
FROM logs WHERE NOT (rflag = 'R' AND lstatus = 'O')""",
        "chain_head": wb() + "SELECT max(block_number) AS head FROM logs",
        "decode_rejects": wb()
        + "SELECT COALESCE(reject_reason, 'accepted') AS outcome, count(*) AS n FROM logs GROUP BY 1",
        "decode_transfers": wb() + f"SELECT {O.TRANSFER_VIEW} FROM decoded",
        "value_dec128": wb() + "SELECT tx_hash, log_index, value_string, dec128_ok, value_dec128 FROM decoded",
        "join_block_time": wb() + 'SELECT tx_hash, log_index, block_number, block_time, "timestamp" FROM logs',
        "dedup_transfers": wb() + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        # node exports carry no delivery order: first wins by stored columns
        "rpc_json_decode": wb(arrival=False) + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        "aggregates_all": O.aggregate_sql(),
        "aggregates_token": O.aggregate_sql(f"token = '{TOKEN}'"),
        "aggregates_blocks": O.aggregate_sql(f"block_number BETWEEN {BLOCK_LO} AND {BLOCK_HI}"),
        "aggregates_time": O.aggregate_sql(f'"timestamp" BETWEEN {t_lo} AND {t_hi}'),
        "aggregates_empty": O.aggregate_sql(f"token = '{MIXED_CASE_TOKEN}'"),
        "aggregates_sketched": "SELECT total_transfers, total_value, total_value_decimal, time_start, time_end, TRUE AS tokens_close, TRUE AS addresses_close FROM ("
        + O.aggregate_sql() + ") x",
        "exact_total": wb(
            """s AS (SELECT count(*) AS total_transfers, count_if(wide) AS n_wide,
                     COALESCE(sum(CASE WHEN wide THEN 0 ELSE v END), 0) AS small FROM transfers)"""
        )
        + f"SELECT total_transfers, {O.big_sum_text(wide_terms, 'small')} AS exact_total FROM s",
        "legacy_value_sum": wb(
            """s AS (SELECT count(*) AS total_transfers,
                     count_if(wide AND block_number <= 1200) AS n_wide,
                     COALESCE(sum(CASE WHEN wide THEN 0 ELSE v END), 0) AS small FROM transfers)"""
        )
        + f"SELECT total_transfers, {O.big_sum_text(wide_terms, 'small')} AS total_value FROM s",
        "filter_token": O.listing_sql(f"token = '{TOKEN}'"),
        "filter_from": O.listing_sql(f"\"from\" = '{SENDER}'"),
        "filter_to": O.listing_sql(f"\"to\" = '{RECEIVER}'"),
        "filter_block_range": O.listing_sql(f"block_number BETWEEN {BLOCK_LO} AND {BLOCK_HI}"),
        "filter_time_range": O.listing_sql(f'"timestamp" BETWEEN {t_lo} AND {t_hi}'),
        "page_first": O.listing_sql(limit=100),
        "page_clamped": O.listing_sql(f"block_number BETWEEN {BLOCK_LO} AND {BLOCK_HI}", limit=1000),
        "page_offset": O.listing_sql(limit=50, offset=250),
        "page_deep_offset": O.listing_sql(limit=100, offset="(SELECT count(*) // 2 FROM transfers)"),
        "page_after_key": O.listing_sql(
            f"""(block_number < {AFTER_KEY[0]} OR block_number = {AFTER_KEY[0]} AND (log_index > {AFTER_KEY[1]}
                 OR log_index = {AFTER_KEY[1]} AND tx_hash > '{AFTER_KEY[2]}'))""", limit=100),
        "request_table": O.request_table_sql(),
        "page_total": wb() + "SELECT count(*) AS total FROM transfers WHERE block_number >= 1000",
        "address_universe": wb()
        + 'SELECT "from" AS address FROM transfers UNION SELECT "to" AS address FROM transfers',
        "distinct_blocks": wb() + "SELECT DISTINCT block_number FROM logs",
        "insert_ignore": wb()
        + f"""SELECT {O.TRANSFER_VIEW} FROM transfers t
WHERE block_number >= 1001 AND NOT EXISTS (
  SELECT 1 FROM transfers f WHERE f.block_number BETWEEN 1 AND 1200 AND f.okey = t.okey AND f.lnum = t.lnum)""",
        "processed_blocks_upsert": wb()
        + f"""SELECT DISTINCT b AS block_number FROM (SELECT max(block_number) AS h FROM logs) m,
  LATERAL (SELECT unnest(range({SC.TICK}, {SC.SPLIT_BLOCK + 1}, {SC.TICK})) AS b
           UNION ALL SELECT unnest(range({2 * SC.TICK}, h + 1, {2 * SC.TICK})) UNION ALL SELECT h) x""",
        "last_processed_block": wb() + "SELECT max(block_number) AS last_block FROM logs",
        "ingest_block_range": wb()
        + """SELECT s AS from_block, least(s + 99, h) AS to_block
FROM (SELECT max(block_number) AS h FROM logs) m, generate_series(1, m.h, 100) AS g(s)""",
        "resume_range": wb()
        + f"""SELECT CAST({SC.SPLIT_BLOCK + 1} AS BIGINT) AS from_block,
  CASE WHEN {SC.SPLIT_BLOCK + 1} > h THEN NULL ELSE least({SC.SPLIT_BLOCK + BATCH}, h) END AS to_block, {SC.SPLIT_BLOCK + 1} > h AS noop
FROM (SELECT max(block_number) AS h FROM logs)""",
        "ingest_counters": wb(
            """c AS (SELECT (block_number - 1) // 100 AS rid, count(*) AS rows_read,
                  count_if(reject_reason = 'topic_count') AS rejected_topic_count,
                  count_if(reject_reason = 'signature') AS rejected_signature,
                  count_if(reject_reason = 'data_length') AS rejected_data_length,
                  count_if(reject_reason IS NULL) AS accepted
                FROM logs WHERE NOT (rflag = 'R' AND lstatus = 'O') GROUP BY 1)""",
            "i AS (SELECT (block_number - 1) // 100 AS rid, count(*) AS inserted FROM transfers GROUP BY 1)",
            "h AS (SELECT max(block_number) AS h FROM logs)",
        )
        + """SELECT rid * 100 + 1 AS from_block, least(rid * 100 + 100, h.h) AS to_block, rows_read,
  rejected_topic_count, rejected_signature, rejected_data_length, CAST(0 AS BIGINT) AS missing_block, accepted,
  COALESCE(inserted, 0) AS inserted, accepted - COALESCE(inserted, 0) AS duplicates, 'ok' AS status
FROM c LEFT JOIN i USING (rid), h""",
        "stream_ingest": wb() + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        "stream_late_headers": wb() + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        "rpc_stream_ingest": wb(arrival=False) + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        "forced_restart": wb() + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        "backfill_extends": wb() + f"SELECT {O.TRANSFER_VIEW} FROM transfers",
        # a key stays in one block, so leaving out blocks commutes with the dedup
        "missing_header_quarantine": wb()
        + f"""SELECT 'stored' AS place, tx_hash, log_index, block_number FROM transfers WHERE block_number % {SC.GAP} <> 0
UNION ALL SELECT 'quarantined', tx_hash, log_index, block_number FROM logs
WHERE block_number % {SC.GAP} = 0 AND NOT (rflag = 'R' AND lstatus = 'O')""",
        "feed_snapshot": feed_sql,
        "feed_after_position": feed_sql + f" OFFSET {FEED_BUFFER}",
        "transfer_feed_json": wb()
        + """SELECT 'Transfer' AS event_signature, token, "from", "to", value_string AS value, value_string, value_decimal, block_number,
  tx_hash, tx_index, log_index, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM transfers""",
        "dedup_tx_24h": wb() + "SELECT DISTINCT tx_hash, CAST(1 AS BIGINT) AS kept FROM decoded",
        **dict.fromkeys(("dedup_tx_chain", "dedup_tx_chain_stream"), """WITH RECURSIVE
p AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts),
kept AS (SELECT user_id, min(ts) AS ts FROM p GROUP BY user_id
         UNION ALL
         SELECT k.user_id, min(p.ts) FROM kept k JOIN p ON p.user_id = k.user_id AND p.ts >= k.ts + INTERVAL 24 HOUR GROUP BY k.user_id)
SELECT event_id, user_id, ts FROM kept JOIN p USING (user_id, ts)"""),
        "slow_batch_flags": """SELECT 'b' || event_id AS batch, event_id AS from_block, event_id + 9 AS to_block, value AS duration_s,
  value > 12 AS slow FROM events""",
        "batch_duration_histogram": "\nUNION ALL\n".join(
            f"SELECT '{CS.le_label(b)}' AS le, count_if(value <= {b}) AS cumulative_count FROM events" for b in BATCH_DURATION_BOUNDS
        )
        + "\nUNION ALL\nSELECT '+Inf' AS le, count(*) AS cumulative_count FROM events",
        "call_errors": "WITH "
        + O.CALL_LOG_CTE.strip()
        + "\nSELECT provider, error, count(*) AS errors FROM call_log WHERE NOT ok GROUP BY provider, error",
        "stream_batch_log": wb()
        + f"""SELECT CAST({SC.STREAM_FILES // SC.FILES_PER_TRIGGER} AS BIGINT) AS batches, count(*) AS rows_read,
  count_if(reject_reason = 'topic_count') AS rejected_topic_count,
  count_if(reject_reason = 'signature') AS rejected_signature,
  count_if(reject_reason = 'data_length') AS rejected_data_length, CAST(0 AS BIGINT) AS missing_block,
  count_if(reject_reason IS NULL) AS accepted, (SELECT count(*) FROM transfers) AS inserted,
  count_if(reject_reason IS NULL) - (SELECT count(*) FROM transfers) AS duplicates
FROM logs WHERE NOT (rflag = 'R' AND lstatus = 'O')""",
        "call_counters": "WITH "
        + O.CALL_LOG_CTE.strip()
        + "\nSELECT provider, method, count(*) AS requests, count_if(NOT ok) AS errors "
        "FROM call_log GROUP BY provider, method",
        "call_duration_histogram": hist_sql,
        "call_duration_sum": "WITH "
        + O.CALL_LOG_CTE.strip()
        + "\nSELECT provider, method, CAST(sum(CAST(duration_s AS DECIMAL(20,6))) AS DOUBLE) AS duration_sum, "
        "count(*) AS duration_count FROM call_log GROUP BY provider, method",
        "failure_streaks": streak_sql(5),
        "failure_streaks_min3": streak_sql(STREAK_MIN),
        "failure_streaks_stream": streak_sql(STREAK_MIN),
        # the stream's files are ranges of blocks of one length, so a micro-batch is a pair of ranges
        "stream_progress": wb() + f"""SELECT {micro} AS batches, count(DISTINCT (block_number - lo) // step // {SC.FILES_PER_TRIGGER}) AS with_rows, {micro} AS over_0_s,
  CAST(0 AS BIGINT) AS over_1_day
FROM logs, (SELECT min(block_number) AS lo, CAST(ceil((max(block_number) - min(block_number) + 1) / {SC.STREAM_FILES}) AS BIGINT) AS step FROM logs)""",
        "block_height": "WITH "
        + O.CALL_LOG_CTE.strip()
        + "\nSELECT provider, arg_max(height, {'ts': ts, 'seq': seq}) AS height FROM call_log GROUP BY provider",
    }
