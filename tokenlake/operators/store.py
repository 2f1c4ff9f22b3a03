"""Transfer store on Parquet: insert-ignore (K1/J2), progress upsert (K2), layout (K4), feed (K3).

Plain Parquet has no transactions, so an attempt writes its rows to ``_staging`` and one small log
entry commits them: ``_log/gen=<g>/<seq>.json``, created only if no entry has that number yet. The
rows are then moved to ``data/seq=<seq>``, so readers read ``data`` as it is and need no list of
batches. A crash before the entry leaves nothing visible; a crash between the entry and the move is
finished by the next reader or writer. Two writers that started from the same number cannot
both commit: the second fails with ``ConcurrentCommit`` and tries again on what the first has stored, which keeps
(tx_hash, log_index) unique. Renaming must be atomic and fail on an existing target: local disks and
HDFS do that, object stores such as S3 do not and need a file system layer that does.

Entries carry progress (K2) and counters (O1). Every ``GENERATION`` entries they are rolled up into one
Parquet table, so a reader opens that table and the entries after it, never the older ones.

The unique key has an index of its own: ``keys/after=<seq>/upto=<seq>/kb=<bucket>`` holds the keys of the commits
between, dealt by a hash of tx_hash into folders. It is made from committed
rows, so it may lag behind: the keys of younger commits are read from ``data``. A batch reads only the
buckets that its own hashes fall into, whatever block they are in. ``summaries/after=/upto=`` holds a row per block
bucket for the same commits (``sketches``).
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BLOCK_BUCKET_SIZE, FEED_BUFFER, FEED_JSON_KEYS, PROCESSED_BLOCK_SCHEMA, VALUE_PARTS_TYPE
from . import decode as D
from . import dedup as DD

TRANSFER_STORE_SCHEMA = T.StructType(
    [
        T.StructField("event_signature", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("value_hex", T.StringType()),
        T.StructField("value_parts", VALUE_PARTS_TYPE),
        T.StructField("value_string", T.StringType()),
        T.StructField("value_dec128", T.DecimalType(38, 0)),
        T.StructField("dec128_ok", T.BooleanType()),
        T.StructField("value_decimal", T.DoubleType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("tx_index", T.IntegerType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("block_bucket", T.LongType()),
    ]
)

STORED_SCHEMA = T.StructType(TRANSFER_STORE_SCHEMA.fields + [T.StructField("seq", T.LongType())])

#: log entries in a folder, rolled up when it is full
GENERATION = 1000
#: folders of the key index; a batch's touched buckets fit the bits of one BIGINT
KEY_BUCKETS = 64
#: commits, or bytes of their data, that may be without key index and summaries before they get them
OPEN_COMMITS, OPEN_BYTES = 100, 64 << 20
#: columns of which every row group keeps a Bloom filter: lookups by sender or receiver skip row groups
BLOOM_COLUMNS = ("from", "to")

KEY_SCHEMA = T.StructType([T.StructField("tx_hash", T.StringType()), T.StructField("log_index", T.IntegerType()),
                           T.StructField("after", T.LongType()), T.StructField("upto", T.LongType()), T.StructField("kb", T.IntegerType())])

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: publish order of the feed: commits, then chain order
FEED_ORDER = ("seq", "block_number", "log_index", "tx_hash")
BATCH_COUNTERS = ["rows_read", "rejected_topic_count", "rejected_signature", "rejected_data_length",
                  "missing_block", "accepted"]
ENTRY_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("seq", "covered_from", "covered_to", "from_block", "to_block",
                                              "marked_at_us", "started_us", "inserted", *BATCH_COUNTERS)]
    + [T.StructField(c, T.StringType()) for c in ("batch", "status", "error_type", "staging")]
)


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this batch was compared with the store."""


class Files:
    """Hadoop FileSystem calls on the store's small files and folders."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(self._conf)
        self._gateway = spark.sparkContext._gateway

    def exists(self, p: str) -> bool:
        return bool(self.fs.exists(self._path(p)))

    def move(self, source: str, target: str) -> bool:
        """Renames; False if the target is there already."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self._gateway.new_array(options, 1)
        none[0] = options.NONE
        self.fs.mkdirs(self._path(target).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self._conf) if "://" in target else (
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        )
        try:
            context.rename(self._path(source), self._path(target), none)
        except Exception:  # noqa: BLE001 - the Java exception differs between file systems
            if self.exists(target):
                return False
            raise
        return True

    def write_text(self, p: str, text: str) -> None:
        out = self.fs.create(self._path(p), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def discard(self, p: str) -> None:
        """Deletes a folder of this run's own staging, if it is there."""
        self.fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        if not self.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p)))

    def statuses(self, p: str) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time) of a file, or of all files under a folder, by path."""
        if not self.exists(p):
            return []
        files, out = self.fs.listFiles(self._path(p), True), []
        while files.hasNext():
            s = files.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)


def key_bucket(tx_hash: Column) -> Column:
    """The key index folder of a transaction; a hash, since leading digits need not be spread evenly."""
    return F.pmod(F.hash(tx_hash), F.lit(KEY_BUCKETS))


def bucket_mask(tx_hash: Column) -> Column:
    """Aggregate: one bit for each bucket that the rows fall into."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), key_bucket(tx_hash)))


def buckets_of(mask: int | None) -> list[int]:
    return [b for b in range(KEY_BUCKETS) if (mask or 0) >> b & 1]


def write_layout(rows: DataFrame, path: str) -> None:
    """K4: folders by ``block_bucket``, files with ranges of (token, block), rows sorted by them in each file.

    One layout for every size: rows are dealt by range on (bucket, token, block, key), so files hold disjoint
    token ranges, a hot token spreads over several files, and min/max of files and row groups prune
    token and block filters. Senders and receivers lie anywhere, so row groups carry Bloom filters of them, sized by
    the values they hold; a row group whose values all fit a dictionary is skipped by that instead. ``rows`` may still be without amounts (``record_columns``): the range
    partitioner reads its input twice, so the amount arithmetic comes after it.
    """
    bucket = F.expr(f"block_number div {BLOCK_BUCKET_SIZE}")
    laid = rows.repartitionByRange(bucket, "token", "block_number", "tx_hash", "log_index")
    # the writer wants rows grouped by folder: with the bucket first it keeps this order; the amounts are made after the sort, which then holds half as much
    if "value_parts" not in rows.columns:
        ordered = D.decode_amounts(laid.sortWithinPartitions(bucket, "token", "block_number"))
    else:
        ordered = laid.sortWithinPartitions("block_bucket", "token", "block_number")
    ordered = ordered.select(*TRANSFER_STORE_SCHEMA.fieldNames())
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM_COLUMNS} | {"parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"}
    ordered.write.mode("overwrite").options(**blooms).partitionBy("block_bucket").parquet(path)


class TransferStore:
    """Committed transfers, their progress marks and the batch log."""

    def __init__(self, spark: SparkSession, root: str, open_commits: int = OPEN_COMMITS, open_bytes: int = OPEN_BYTES):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fs = Files(spark, self.root)
        self.open_commits, self.open_bytes = open_commits, open_bytes

    # --- paths
    def _data(self, seq: int) -> str:
        return f"{self.root}/data/seq={seq:012d}"

    def staging(self, name: str) -> str:
        return f"{self.root}/_staging/{name}"

    def _entry(self, seq: int) -> str:
        return f"{self.root}/_log/gen={(seq - 1) // GENERATION:09d}/{seq:012d}.json"

    def _done(self, batch_id: str) -> str:
        return f"{self.root}/_batches/{batch_id}"

    # --- the log
    def last_seq(self) -> int:
        """Number of the last entry, 0 if there is none; finishes what a crash left between entry and move."""
        generations = self.fs.names(f"{self.root}/_log")
        if not generations:
            return 0
        seq = max(int(n[:12]) for n in self.fs.names(f"{self.root}/_log/{generations[-1]}"))
        entry = json.loads(self.fs.read_text(self._entry(seq)))
        self._settle(entry)
        return seq

    def _settle(self, entry: dict) -> None:
        name = entry.get("staging")
        for source, target in ((name, self._data(entry["seq"])), (f"{name}-quarantine", f"{self.root}/quarantine/seq={entry['seq']:012d}")):
            if name and self.fs.exists(self.staging(source)):
                self.fs.move(self.staging(source), target)
        if entry["status"] == "ok" and not self.fs.exists(self._done(entry["batch"])):
            self.fs.write_text(self._done(entry["batch"]), str(entry["seq"]))

    def entries(self) -> DataFrame:
        """All log entries: the last roll-up and the entries after it."""
        self.last_seq()
        rolled = [n for n in self.fs.names(f"{self.root}/_rollup") if n.startswith("upto=")]
        upto = int(rolled[-1].split("=")[1]) if rolled else 0
        open_ = [n for n in self.fs.names(f"{self.root}/_log") if int(n.split("=")[1]) * GENERATION >= upto]
        parts = []
        if rolled:
            parts.append(self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.root}/_rollup/{rolled[-1]}"))
        if open_:
            parts.append(self.spark.read.schema(ENTRY_SCHEMA).json([f"{self.root}/_log/{n}" for n in open_]))
        if not parts:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _append(self, entry: dict, seq: int) -> None:
        """Creates entry ``seq``: the commit."""
        entry = entry | {"seq": seq, "marked_at_us": (datetime.now(timezone.utc) - _EPOCH) // timedelta(microseconds=1)}
        tmp = self.staging(f"entry-{uuid.uuid4().hex}")
        self.fs.write_text(tmp, json.dumps(entry) + "\n")
        if not self.fs.move(tmp, self._entry(seq)):
            raise ConcurrentCommit(f"entry {seq} of {self.root} is taken")
        self._settle(entry)
        if seq % GENERATION == 0:
            # runs first: progress reads them up to the roll-up that names them
            for kind, rows in (("runs", covered_runs(self._covered())), ("rollup", self.entries().coalesce(1))):
                tmp = self.staging(f"{kind}-{uuid.uuid4().hex}")
                rows.write.parquet(tmp)
                self.fs.move(tmp, f"{self.root}/_{kind}/upto={seq:012d}")

    def is_committed(self, batch_id: str) -> bool:
        self.last_seq()
        return self.fs.exists(self._done(batch_id))

    def committed(self) -> DataFrame:
        return self.entries().where("status = 'ok'").select("seq", "batch")

    # --- reads
    def read_stored(self) -> DataFrame:
        """Committed rows with ``seq``, the number of the batch that inserted them."""
        self.last_seq()
        if not self.fs.names(f"{self.root}/data"):
            return self.spark.createDataFrame([], STORED_SCHEMA)
        return self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.root}/data")

    def read(self) -> DataFrame:
        """Every committed transfer; partition column ``block_bucket`` is pruned by filters."""
        return self.read_stored().drop("seq")

    def read_batch(self, batch_id: str) -> DataFrame:
        """The rows one batch inserted."""
        if not self.is_committed(batch_id):
            raise KeyError(f"batch {batch_id} is not committed")
        return self.read_stored().where(F.col("seq") == int(self.fs.read_text(self._done(batch_id)))).drop("seq")

    def quarantined(self, schema: T.StructType) -> DataFrame:
        """Raw logs kept aside because their block's header was missing."""
        path = f"{self.root}/quarantine"
        return self.spark.read.schema(schema).parquet(path) if self.fs.exists(path) else self.spark.createDataFrame([], schema)

    def indexed_upto(self, kind: str = "keys") -> int:
        """The last commit that the key index (or the summaries) holds.

        Folders form a chain, ``after=<seq>/upto=<seq>``; a second one after the same commit cannot be created, so none overlap.
        """
        chain = [n for n in self.fs.names(f"{self.root}/{kind}") if n.startswith("after=")]
        return int(self.fs.names(f"{self.root}/{kind}/{chain[-1]}")[-1].split("=")[1]) if chain else 0

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        """The unique key's columns and their bucket: (kb, tx_hash, log_index) of every stored row, or of some buckets.

        ``buckets`` is a partition filter on the key index; of commits that are not in it yet all keys are read.
        """
        upto = self.indexed_upto()
        young = self.read_stored().where(F.col("seq") > upto).select(key_bucket(F.col("tx_hash")).alias("kb"), "tx_hash", "log_index")
        if buckets is not None:
            young = young.where(F.col("kb").isin(buckets))
        if not upto:
            return young
        old = self.spark.read.schema(KEY_SCHEMA).parquet(f"{self.root}/keys")
        return (old if buckets is None else old.where(F.col("kb").isin(buckets))).select(*young.columns).unionByName(young)

    def summaries(self) -> tuple[DataFrame | None, int]:
        """Summaries by block bucket (``sketches.summarise``) and the last commit that they hold."""
        upto = self.indexed_upto("summaries")
        return (self.spark.read.parquet(f"{self.root}/summaries").drop("after", "upto") if upto else None), upto

    def index_commits(self) -> None:
        """Adds keys and summaries of the commits without them, in one folder for all of these commits.

        Both are made from committed rows, so a crash in between loses nothing: the next call makes what is missing.
        """
        from . import sketches

        def keyed(rows: DataFrame) -> DataFrame:
            keys = rows.select(key_bucket(F.col("tx_hash")).alias("kb"), "tx_hash", "log_index")
            # range partitioning: a bucket that outgrows a task spreads over several
            return keys.repartitionByRange("kb", "tx_hash", "log_index").sortWithinPartitions("kb", "tx_hash", "log_index")

        last = self.last_seq()
        for kind, make, folders in (("keys", keyed, ["kb"]), ("summaries", sketches.summarise, [])):
            upto = self.indexed_upto(kind)
            if last == upto or not self.fs.names(f"{self.root}/data"):
                continue
            tmp = self.staging(f"{kind}-{uuid.uuid4().hex}")
            make(self.read_stored().where(F.col("seq").between(upto + 1, last))).write.option("compression", "zstd").partitionBy(*folders).parquet(f"{tmp}/upto={last:012d}")
            self.fs.move(tmp, f"{self.root}/{kind}/after={upto:012d}")  # False: another writer was first

    def _index_when_due(self) -> None:
        upto, last = self.indexed_upto(), self.last_seq()
        waiting = [self._data(seq) for seq in range(upto + 1, last + 1)]
        if len(waiting) >= self.open_commits or sum(size for p in waiting for _, size, _ in self.fs.statuses(p)) >= self.open_bytes:
            self.index_commits()

    def progress(self) -> DataFrame:
        """K2 view: one row per marked block, the latest mark wins (upsert by block_number)."""
        marks = self.entries().where("status = 'ok' AND covered_to IS NOT NULL")
        return upsert_progress(marks.select(F.col("covered_to").alias("block_number"), F.timestamp_micros("marked_at_us").alias("processed_at")))

    def _covered(self) -> DataFrame:
        """Covered ranges in the shape of entries: the runs of the last roll-up, and the entries after it."""
        rolled = [n for n in self.fs.names(f"{self.root}/_runs") if n.startswith("upto=")]
        upto = int(rolled[-1].split("=")[1]) if rolled else 0
        young = self.entries().where(F.col("seq") > upto).select("covered_from", "covered_to", "status")
        return young.unionByName(self.spark.read.schema(young.schema).parquet(f"{self.root}/_runs/{rolled[-1]}")) if rolled else young

    def contiguous(self, start_block: int | None = None) -> DataFrame:
        """S6 as one row ``last_block``; what goes through the window is bounded by a roll-up's entries and the gaps before it."""
        return contiguous_progress(self._covered(), start_block)

    def last_processed_block(self, start_block: int | None = None) -> int:
        """The block up to which everything from ``start_block`` on is ingested, 0 if nothing is."""
        return int(self.contiguous(start_block).first()["last_block"])

    def batch_log(self) -> DataFrame:
        """One row per batch that recorded counters, failed ones included."""
        return self.entries().where("started_us IS NOT NULL").select(
            "batch", "from_block", "to_block", *BATCH_COUNTERS, "inserted",
            (F.col("accepted") - F.col("inserted")).alias("duplicates"),
            F.timestamp_micros("started_us").alias("started_at"),
            ((F.col("marked_at_us") - F.col("started_us")) / 1e6).alias("duration_s"),
            "status", "error_type",
        )

    def feed(self) -> DataFrame:
        """K3: every committed transfer as JSON; ``seq`` is the publish order of the batches."""
        return self.read_stored().select(*FEED_ORDER, transfer_json().alias("json"))

    def feed_after(self, position: tuple[int, int, int, str] | None = None, limit: int = FEED_BUFFER) -> DataFrame:
        """The first ``limit`` feed rows after ``position`` (seq, block_number, log_index, tx_hash), by default from the start.

        Commits before the position's are not read; a page is the top of each task, merged.
        """
        rows = self.feed()
        if position is not None:
            past = F.lit(False)
            for i in reversed(range(len(FEED_ORDER))):
                here, at = F.col(FEED_ORDER[i]), F.lit(position[i])
                past = (here > at) | ((here == at) & past)
            rows = rows.where((F.col("seq") >= position[0]) & past)
        return rows.orderBy(*FEED_ORDER).limit(limit)

    # --- writes (K1, K2, O1)
    def insert_ignore(self, transfers: DataFrame, batch_id: str, covered: tuple[int, int] | None = None,
                      log: dict | None = None, deduped: bool = False, quarantine: DataFrame | None = None,
                      buckets: list[int] | None = None) -> int:
        """K1: append the batch's rows whose key is not stored yet; first wins, globally.

        In-batch duplicates go first (D1; skipped when the caller already did it with
        ``deduped=True``), then an anti-join against the stored keys of the key buckets that the batch touches
        (``buckets``, looked up where not given); it is never pruned by block range, because a key may come back in
        another block after a reorganisation. ``covered`` is
        the block range that the batch has ingested in full (K2). Returns rows inserted; a batch that is
        already committed is skipped (retry after success).
        """
        if self.is_committed(batch_id):
            return 0
        seq = self.last_seq() + 1
        fresh = transfers if deduped else DD.dedup_transfers(transfers)
        if seq > 1:
            if buckets is None:
                buckets = buckets_of(fresh.agg(bucket_mask(F.col("tx_hash"))).first()[0])
            # the bucket follows from tx_hash and only prunes folders: without it the join keeps the dedup's partitioning
            fresh = fresh.join(self.keys(buckets).drop("kb"), ["tx_hash", "log_index"], "left_anti")
        name = f"{seq:012d}-{uuid.uuid4().hex[:12]}"
        write_layout(fresh, self.staging(name))
        inserted = self.spark.read.schema(TRANSFER_STORE_SCHEMA).parquet(self.staging(name)).count()  # Parquet footers only
        if quarantine is not None:
            quarantine.write.parquet(self.staging(f"{name}-quarantine"))
        self._append(_entry(batch_id, "ok", covered, log) | {"inserted": int(inserted), "staging": name}, seq)
        self._index_when_due()
        return inserted

    def mark_processed(self, covered: tuple[int, int], batch_id: str) -> None:
        """K2 on its own: a batch with no data that only marks progress."""
        self._append(_entry(batch_id, "ok", covered, None), self.last_seq() + 1)

    def record_failure(self, batch_id: str, error: BaseException, log: dict | None = None) -> None:
        """O1: a failed attempt in the batch log, with its error type; it stores nothing and marks nothing.

        Another writer may take the entry's number meanwhile; then the next one is tried, so the caller's error is not hidden.
        """
        entry = _entry(batch_id, "error", None, log) | {"inserted": 0, "error_type": type(error).__name__}
        while True:
            try:
                return self._append(entry, self.last_seq() + 1)
            except ConcurrentCommit:
                continue


def _entry(batch_id: str, status: str, covered: tuple[int, int] | None, log: dict | None) -> dict:
    entry = {"batch": batch_id, "status": status}
    if covered is not None and covered[0] <= covered[1]:
        entry |= {"covered_from": int(covered[0]), "covered_to": int(covered[1])}
    if log is not None:
        entry |= {c: int(log.get(c) or 0) for c in BATCH_COUNTERS}
        entry |= {c: None if log.get(c) is None else int(log[c]) for c in ("from_block", "to_block")}
        entry["started_us"] = int(log["started"] * 1_000_000)
    return entry


def upsert_progress(marks: DataFrame) -> DataFrame:
    """K2: one row per block_number, the latest ``processed_at`` wins."""
    return marks.groupBy("block_number").agg(F.max("processed_at").alias("processed_at"))


def last_processed(progress: DataFrame) -> DataFrame:
    """``coalesce(max(block_number), 0)`` as one row ``last_block``."""
    return progress.agg(F.coalesce(F.max("block_number"), F.lit(0).cast("bigint")).alias("last_block"))


def covered_runs(entries: DataFrame) -> DataFrame:
    """The covered ranges of ok entries merged into gap-free runs, in the shape of entries."""
    marks = entries.where("status = 'ok' AND covered_to IS NOT NULL").select("covered_from", "covered_to")
    order = Window.orderBy("covered_from", "covered_to")
    reached = F.max("covered_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("covered_from") > reached + 1).cast("int"), F.lit(1))
    runs = marks.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(F.min("covered_from").alias("covered_from"), F.max("covered_to").alias("covered_to"), F.lit("ok").alias("status")).drop("run")


def contiguous_progress(entries: DataFrame, start_block: int | None = None) -> DataFrame:
    """S6 without gaps, as one row ``last_block``: the end of the covered run that starts at
    ``start_block`` or before it (by default at the first covered block); 0 if there is none.

    One row per batch goes through the window, not one per transfer.
    """
    marks = entries.where("status = 'ok' AND covered_to IS NOT NULL").select("covered_from", "covered_to")
    if start_block is not None:
        marks = marks.where(F.col("covered_to") >= F.lit(start_block - 1))
    before = Window.orderBy("covered_from", "covered_to").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(start_block - 1).cast("bigint") if start_block is not None else F.col("covered_from") - 1
    reached = F.coalesce(F.max("covered_to").over(before), first)
    if start_block is not None:
        reached = F.greatest(reached, first)
    runs = marks.withColumn("reached", reached).withColumn("gap", F.col("covered_from") > F.col("reached") + 1)
    stop = F.min(F.when(F.col("gap"), F.col("reached")))
    last = F.coalesce(stop, F.max("covered_to"), F.lit(0).cast("bigint"))
    if start_block is not None:
        last = F.when(last < F.lit(start_block), F.lit(0).cast("bigint")).otherwise(last)
    return runs.agg(last.alias("last_block"))


def transfer_json():
    """The record as JSON with the reference's key names; ``value`` as exact text."""
    shown = {
        "value": F.col("value_string"),
        "timestamp": F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "created_at": F.date_format(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    }
    return F.to_json(F.struct(*[shown.get(k, F.col(k)).alias(k) for k in FEED_JSON_KEYS]))
