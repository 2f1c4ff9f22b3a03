"""Ingestion scenarios behind the store and stream queries.

Each scenario runs the real ingest path on data derived from the given tables,
in the shared checkpoint folder, and returns a TransferStore to query.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as CH
from ..operators.store import Files, TransferStore
from ..schemas import BLOCK_SCHEMA
from ..sources import fixtures as FX
from ..sources import landing as L
from ..streaming import ingest as I
from ..streaming import progress as PR
from ..streaming import streaks as STK

STREAM_FILES = 8  # raw-log files the node "produces" over time
FILES_PER_TRIGGER = 2
SPLIT_BLOCK = 1200  # first backfill ends here; the replayed batch starts before it
REPLAY_FROM = 1001
TICK = 400  # blocks of a tick in the range scenarios
LATE = 7  # logs of every LATE-th block arrive late
GAP = 50  # headers of every GAP-th block are missing


def _in_block_order(spark: SparkSession, sf_dir: str, path: str, write, rows_per_file: int = L.ROWS_PER_FILE) -> None:
    """The landed raw logs cut into STREAM_FILES ranges of blocks and appended to ``path`` by ``write`` one after another, oldest first,
    as a node would deliver them.

    The stream takes files in order, so every range has the same number of files, as many as its logs need: a range with
    fewer gets empty ones. A range is read from the landed files that hold its blocks, without a shuffle or a sort.
    """
    raw, files = L.landed_raw_logs(spark, sf_dir), Files(spark, path)
    held = raw.where("block_number IS NOT NULL").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("block_number").alias("lo"), F.max("block_number").alias("hi")).collect()  # fmt: skip - a row for each landed file
    lo, hi = min(f.lo for f in held), max(f.hi for f in held)
    step = max(1, -(-(hi - lo + 1) // STREAM_FILES))
    largest = raw.where("block_number IS NOT NULL").groupBy(F.expr(f"(block_number - {lo}) div {step}")).count().agg(F.max("count")).first()[0]
    each = -(-largest // rows_per_file)
    for k in range(STREAM_FILES):
        first, last = lo + k * step, lo + (k + 1) * step - 1
        here = [f.file for f in held if f.lo <= last and f.hi >= first]
        rows = spark.read.schema(L.LANDED_LOG_SCHEMA).parquet(*here) if here else raw
        write(rows.where(F.col("block_number").between(first, last)).coalesce(each), path)
        while _delivered(files, path) < (k + 1) * each:
            write(raw.limit(0).coalesce(1), path)


def _delivered(files: Files, path: str) -> int:
    return len([n for n in files.names(path) if n.startswith("part-")])


def _per_trigger(spark: SparkSession, path: str, ranges: int) -> int:
    """Files of so many ranges of blocks (``_in_block_order``)."""
    return _delivered(Files(spark, path), path) // STREAM_FILES * ranges


def stream_input(spark: SparkSession, sf_dir: str) -> str:
    """Landed raw logs as Parquet files of STREAM_FILES consecutive block ranges."""
    path = f"{L.land_root(spark, sf_dir)}/stream_input"

    def write(p: str) -> None:
        _in_block_order(spark, sf_dir, p, lambda part, to: part.write.mode("append").option("compression", "zstd").parquet(to))

    L.materialise(spark, path, write)
    return path


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _streamed(spark: SparkSession, sf_dir: str, store: TransferStore, checkpoint: str, blocks, **options):
    source = stream_input(spark, sf_dir)
    return I.stream_ingest(spark, source, blocks, store, checkpoint, max_files_per_trigger=_per_trigger(spark, source, FILES_PER_TRIGGER),
                           schema=L.LANDED_LOG_SCHEMA, **options)


def streamed_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """The store filled by a Structured Streaming run over the stream input."""
    path = f"{L.land_root(spark, sf_dir)}/stream_store"

    def write(p: str) -> None:
        blocks = L.landed_blocks(spark, sf_dir)
        _run(_streamed(spark, sf_dir, TransferStore(spark, p + "/store"), p + "/checkpoint", blocks, start_block=1))

    L.materialise(spark, path, write)
    return TransferStore(spark, path + "/store")


def late_header_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """Headers up to SPLIT_BLOCK are there when the stream starts; it fails at the first batch that needs
    more, the rest of the headers arrives, and the query goes on from its checkpoint."""
    path = f"{L.land_root(spark, sf_dir)}/late_headers"

    def write(p: str) -> None:
        store, headers = TransferStore(spark, p + "/store"), p + "/headers"
        known = L.landed_blocks(spark, sf_dir)
        known.where(F.col("block_number") <= SPLIT_BLOCK).write.parquet(headers)
        blocks = lambda: spark.read.schema(BLOCK_SCHEMA).parquet(headers)
        try:
            _run(_streamed(spark, sf_dir, store, p + "/checkpoint", blocks, start_block=1))
        except StreamingQueryException as error:
            if "MissingHeaders" not in str(error):
                raise
            known.where(F.col("block_number") > SPLIT_BLOCK).write.mode("append").parquet(headers)
            _run(_streamed(spark, sf_dir, store, p + "/checkpoint", blocks, start_block=1))

    L.materialise(spark, path, write)
    return TransferStore(spark, path + "/store")


def quarantine_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """J1 with quarantine: a backfill without the headers of every GAP-th block."""
    path = f"{L.land_root(spark, sf_dir)}/quarantine_store"

    def write(p: str) -> None:
        blocks = L.landed_blocks(spark, sf_dir)
        I.backfill(TransferStore(spark, p), L.landed_raw_logs(spark, sf_dir), blocks.where(F.col("block_number") % GAP != 0),
                   from_block=1, to_block=I.chain_head(blocks), missing="quarantine")

    L.materialise(spark, path, write)
    return TransferStore(spark, path)


def first_run_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """Ticks of TICK blocks up to SPLIT_BLOCK; the logs of every LATE-th block have not arrived yet."""
    path = f"{L.land_root(spark, sf_dir)}/first_run"

    def write(p: str) -> None:
        _first_run(spark, sf_dir, TransferStore(spark, p))

    L.materialise(spark, path, write)
    return TransferStore(spark, path)


def _first_run(spark: SparkSession, sf_dir: str, store: TransferStore) -> None:
    early = L.landed_raw_logs(spark, sf_dir).where(F.col("block_number") % LATE != 0)
    known = L.landed_blocks(spark, sf_dir).where(F.col("block_number") <= SPLIT_BLOCK)
    while I.poll_once(store, early, known, start_block=1, batch_blocks=TICK, head=SPLIT_BLOCK) is not None:
        pass


def restarted_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """A first run, a second run that backfills from there to the head, then, when the late logs have
    arrived, a forced restart from block 1 that runs on to the head in ranges of 2 x TICK blocks."""
    path = f"{L.land_root(spark, sf_dir)}/restarted"

    def write(p: str) -> None:
        store = TransferStore(spark, p)
        _first_run(spark, sf_dir, store)
        raw, blocks = L.landed_raw_logs(spark, sf_dir), L.landed_blocks(spark, sf_dir)
        I.backfill(store, raw.where(F.col("block_number") % LATE != 0), blocks, from_block=store.last_processed_block(1) + 1)
        I.forced_restart(store, raw, blocks, start_block=1, batch_blocks=2 * TICK)

    L.materialise(spark, path, write)
    return TransferStore(spark, path)


def extended_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """Backfill from block 0 to the head twice: the chain has grown from SPLIT_BLOCK to its end in between."""
    path = f"{L.land_root(spark, sf_dir)}/extended"

    def write(p: str) -> None:
        store, raw, blocks = TransferStore(spark, p), L.landed_raw_logs(spark, sf_dir), L.landed_blocks(spark, sf_dir)
        for known in (blocks.where(F.col("block_number") <= SPLIT_BLOCK), blocks):
            I.backfill(store, raw, known, from_block=0)

    L.materialise(spark, path, write)
    return TransferStore(spark, path)


def rpc_streamed_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """S1/S5 over JSON lines in the node's RPC shape, as a stream."""
    from ..sources import rpc as RPC

    path = f"{L.land_root(spark, sf_dir)}/rpc_stream"

    def write(p: str) -> None:
        _in_block_order(spark, sf_dir, p + "/in", lambda part, to: RPC.to_rpc_logs(part).write.mode("append").option("compression", "gzip").json(to))
        _run(I.stream_ingest(spark, p + "/in", L.landed_blocks(spark, sf_dir), TransferStore(spark, p + "/store"), p + "/checkpoint",
                             max_files_per_trigger=_per_trigger(spark, p + "/in", STREAM_FILES // 2), read_logs=RPC.stream_rpc_logs, start_block=1))

    L.materialise(spark, path, write)
    return TransferStore(spark, path + "/store")


def rpc_export(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The landed logs and headers written as JSON lines in the node's RPC shape."""
    from ..sources import rpc as RPC

    root = f"{L.land_root(spark, sf_dir)}/rpc_json"

    def write(p: str) -> None:
        RPC.to_rpc_logs(L.landed_raw_logs(spark, sf_dir)).write.option("compression", "gzip").json(p + "/logs")
        RPC.to_rpc_headers(L.landed_blocks(spark, sf_dir)).write.option("compression", "gzip").json(p + "/headers")

    L.materialise(spark, root, write)
    return root + "/logs", root + "/headers"


def replay_store(spark: SparkSession, sf_dir: str) -> tuple[TransferStore, str]:
    """K1: backfill blocks [1, SPLIT_BLOCK], then one more batch from REPLAY_FROM to the head; the first one's
    keys come from the key index. Returns the store and the replay's batch id."""
    path, blocks = f"{L.land_root(spark, sf_dir)}/replayed", L.landed_blocks(spark, sf_dir)
    head = I.chain_head(blocks)

    def write(p: str) -> None:
        store, raw = TransferStore(spark, p, open_bytes=0), L.landed_raw_logs(spark, sf_dir)
        I.backfill(store, raw, blocks, from_block=1, to_block=SPLIT_BLOCK, run_id="first")
        I.backfill(store, raw, blocks, from_block=REPLAY_FROM, to_block=head, run_id="replay")

    L.materialise(spark, path, write)
    return TransferStore(spark, path), f"replay-{REPLAY_FROM:012d}-{head:012d}"


def _in_time_order(events: DataFrame, path: str) -> None:
    """``events`` as STREAM_FILES folders of consecutive times, written one after another, as they would be logged."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    for k in range(STREAM_FILES if lo is not None else 0):
        step = (hi - lo) / STREAM_FILES
        until = F.lit(True) if k == STREAM_FILES - 1 else F.col("ts") < F.lit(lo + (k + 1) * step)
        events.where((F.col("ts") >= F.lit(lo + k * step)) & until).coalesce(1).write.mode("append").parquet(path)


def streamed_streaks(spark: SparkSession, sf_dir: str, threshold: int) -> DataFrame:
    """The call log as STREAM_FILES files in time order, one micro-batch each; every streak up to the last one."""
    path = f"{L.land_root(spark, sf_dir)}/streaks_{threshold}"

    def write(p: str) -> None:
        log = FX.call_log(spark, sf_dir)
        _in_time_order(log, p + "/in")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(p + "/in")
        _run(STK.streaks_stream(spark, stream, p + "/out", p + "/checkpoint", threshold))

    L.materialise(spark, path, write)
    return STK.streaks_so_far(spark, path + "/out", path + "/checkpoint", STREAM_FILES - 1, threshold)


def watched_stream(spark: SparkSession, sf_dir: str) -> str:
    """A stream ingest with a progress listener; returns the progress table's path."""
    path = f"{L.land_root(spark, sf_dir)}/progress"

    def write(p: str) -> None:
        listener = PR.ProgressLog(spark, p + "/table")
        spark.streams.addListener(listener)
        try:
            _run(_streamed(spark, sf_dir, TransferStore(spark, p + "/store"), p + "/checkpoint", L.landed_blocks(spark, sf_dir), start_block=1))
            PR.wait_for(listener, STREAM_FILES // FILES_PER_TRIGGER)
        finally:
            spark.streams.removeListener(listener)

    L.materialise(spark, path, write)
    return path + "/table"


def chained_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = FILES_PER_TRIGGER) -> str:
    """The events as STREAM_FILES files in time order, deduplicated by user and 24 h as a stream; the output folder."""
    path = f"{L.land_root(spark, sf_dir)}/chained_events_{files_per_trigger}"

    def write(p: str) -> None:
        events = FX.read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
        _in_time_order(events, p + "/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(p + "/in")
        _run(CH.keep_chain_stream(spark, stream, p + "/out", p + "/checkpoint", "user_id", "ts", ["event_id"]))

    L.materialise(spark, path, write)
    return path + "/out"


def published_feed(spark: SparkSession, sf_dir: str) -> str:
    """K3: the streamed store's feed published as JSON lines by a stream over its commits."""
    from ..streaming.feed import publish_feed

    path = f"{L.land_root(spark, sf_dir)}/feed_json"
    store = streamed_store(spark, sf_dir)
    _run(publish_feed(spark, store, path + "/out", path + "/checkpoint"))
    return path + "/out"


def dedup_tx_output(spark: SparkSession, sf_dir: str) -> str:
    """The 24 h tx-hash dedup stream over the stream input; returns its output folder.

    The file sink's log records absolute paths, so this one runs in place; its
    checkpoint makes a rerun a no-op (availableNow finds no new files).
    """
    path, source = f"{L.land_root(spark, sf_dir)}/dedup_tx_24h", stream_input(spark, sf_dir)
    _run(I.dedup_tx_within(
        spark,
        source,
        L.landed_blocks(spark, sf_dir),
        out_dir=path + "/out",
        checkpoint=path + "/checkpoint",
        max_files_per_trigger=_per_trigger(spark, source, 1),  # the state holds the transactions of a micro-batch or two
    ))
    return path + "/out"
