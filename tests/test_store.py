import os

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tokenlake.functions.params import parse_params
from tokenlake.operators import decode as D
from tokenlake.operators import query as Q
from tokenlake.operators.store import ConcurrentCommit, TransferStore
from tokenlake.schemas import BLOCK_SCHEMA, RAW_LOG_SCHEMA, TRANSFER_TOPIC
from tokenlake.sources import landing as L
from tokenlake.streaming import ingest as I

A = "0x" + "00" * 12 + "aa" * 20
B = "0x" + "00" * 12 + "bb" * 20


def raw(spark, rows):
    return spark.createDataFrame(
        [("0x" + "01" * 20, [TRANSFER_TOPIC, A, B], "0x" + format(v, "064x"), blk, tx, 0, li) for v, blk, tx, li in rows],
        RAW_LOG_SCHEMA,
    )


def blocks(spark):
    return spark.createDataFrame([(b, 1000 * b) for b in range(1, 50)], BLOCK_SCHEMA)


def keys(store):
    return sorted((r.tx_hash, r.log_index, r.value_string) for r in store.read().collect())


def test_insert_ignore_first_wins_globally(spark, scratch):
    store = TransferStore(spark, scratch("store"))
    b1 = raw(spark, [(1, 5, "0x01", 0), (2, 5, "0x01", 0), (3, 5, "0x01", 1)])
    assert I.ingest_range(store, b1, blocks(spark), 1, 10, "r-1") == 2
    # same key later, and again in another block (a reorganisation): ignored
    b2 = raw(spark, [(9, 12, "0x01", 0), (4, 13, "0x02", 0), (8, 14, "0x01", 1)])
    assert I.ingest_range(store, b2, blocks(spark), 11, 20, "r-2") == 1
    assert keys(store) == [("0x01", 0, "1"), ("0x01", 1, "3"), ("0x02", 0, "4")]
    assert store.last_processed_block() == 20
    # retry of a committed batch and a forced replay of everything add nothing
    assert I.ingest_range(store, b2, blocks(spark), 11, 20, "r-2") == 0
    assert I.ingest_range(store, b1.unionByName(b2), blocks(spark), 1, 20, "restart-1") == 0
    assert len(keys(store)) == 3
    feed = store.feed().collect()
    assert len(feed) == 3 and all('"value":' in r.json for r in feed)


def test_crash_between_data_and_commit(spark, scratch):
    root = scratch("crash")
    store = TransferStore(spark, root)
    b1 = raw(spark, [(1, 5, "0x01", 0), (2, 6, "0x02", 0)])
    # a crashed attempt: data written, no commit marker, no progress
    transfers, _ = D.decode_logs(b1, blocks(spark))
    transfers.write.parquet(store.staging("000000000001-crashed"))
    assert store.read().count() == 0 and store.last_processed_block() == 0
    assert I.ingest_range(store, b1, blocks(spark), 1, 10, "r-1") == 2  # retry overwrites
    assert store.read().count() == 2 and store.last_processed_block() == 10


def test_resume_and_ranges(spark):
    assert I.resume_from(0, 5) == 5 and I.resume_from(9, 5) == 10
    assert I.next_range(10, 9) is None
    assert I.next_range(10, 100, 10) == (10, 19) and I.next_range(95, 100, 10) == (95, 100)
    r = I.batch_ranges(spark, 1, 25, 10).orderBy("from_block").collect()
    assert [(x.from_block, x.to_block) for x in r] == [(1, 10), (11, 20), (21, 25)]


def test_stream_equals_batch_and_rerun_adds_nothing(spark, scratch):
    src = scratch("stream-src")
    rows = [(v, 1 + v % 30, "0x%02x" % (v % 17), v % 3) for v in range(200)]
    df = raw(spark, rows)
    for k in range(4):  # four files, oldest blocks first
        df.where(F.col("block_number").between(k * 8 + 1, k * 8 + 8)).coalesce(1).write.mode("append").parquet(src)
    store = TransferStore(spark, scratch("stream-store"))
    ckpt = scratch("stream-ckpt")
    q = I.stream_ingest(spark, src, blocks(spark), store, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    batch = TransferStore(spark, scratch("batch-store"))
    I.backfill(batch, df, blocks(spark), 1, 40)
    assert keys(store) == keys(batch)
    assert store.committed().count() == 4
    q = I.stream_ingest(spark, src, blocks(spark), store, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert keys(store) == keys(batch) and store.committed().count() == 4
    # a new checkpoint (forced restart) replays every file; the store absorbs it
    q = I.stream_ingest(spark, src, blocks(spark), store, scratch("stream-ckpt2"), max_files_per_trigger=2)
    q.awaitTermination()
    assert keys(store) == keys(batch)
    assert os.path.basename(store.root)


def test_poll_once_ticks_resume_and_noop(spark, scratch):
    store = TransferStore(spark, scratch("poll"))
    logs = raw(spark, [(v, b, "0x%02x" % b, 0) for v, b in enumerate(range(5, 30))])
    blk = spark.createDataFrame([(b, 1000 * b) for b in range(1, 26)], BLOCK_SCHEMA)  # head 25
    assert I.poll_once(store, logs, blk, start_block=5, batch_blocks=10) == (5, 14)  # no progress: start
    assert I.poll_once(store, logs, blk, start_block=5, batch_blocks=10) == (15, 24)  # last + 1
    assert I.poll_once(store, logs, blk, start_block=5, batch_blocks=10) == (25, 25)  # clamped to head
    n = store.committed().count()
    assert I.poll_once(store, logs, blk, start_block=5, batch_blocks=10) is None  # head below from
    assert store.committed().count() == n and store.last_processed_block() == 25
    assert I.poll_once(store, logs, blk, start_block=5, batch_blocks=500, force_start=True) == (5, 25)
    assert store.read().count() == 21  # the forced replay added nothing


def header_rows(spark, numbers):
    return spark.createDataFrame([(b, 1000 * b) for b in numbers], BLOCK_SCHEMA)


def test_second_backfill_takes_what_the_chain_has_grown(spark, scratch):
    store = TransferStore(spark, scratch("grow"))
    logs = raw(spark, [(1, 5, "0x01", 0), (2, 15, "0x02", 0)])
    assert I.backfill(store, logs, header_rows(spark, range(1, 11)), from_block=0) == 1
    assert I.backfill(store, logs, header_rows(spark, range(1, 21)), from_block=0) == 1
    assert store.read().count() == 2 and store.last_processed_block() == 20
    # the same range of a named run is ingested once, another run of it is looked at again
    assert I.backfill(store, logs, header_rows(spark, range(1, 21)), 0, run_id="a") == 0
    more = logs.unionByName(raw(spark, [(3, 16, "0x03", 0)]))
    assert I.backfill(store, more, header_rows(spark, range(1, 21)), 0, run_id="a") == 0
    assert I.backfill(store, more, header_rows(spark, range(1, 21)), 0, run_id="b") == 1


def test_missing_header_fails_the_batch_or_is_kept_aside(spark, scratch):
    store = TransferStore(spark, scratch("headers"))
    logs = raw(spark, [(1, 5, "0x01", 0), (2, 15, "0x02", 0)])
    four = spark.createDataFrame([("0x" + "01" * 20, [TRANSFER_TOPIC, A, B, B], "0x", 15, "0x09", 0, 0)], RAW_LOG_SCHEMA)
    known = header_rows(spark, [*range(1, 11), 20])
    for some in (logs, logs.where("block_number < 10").unionByName(four)):  # a log that a guard rejects needs its header too
        with pytest.raises(D.MissingHeaders, match="block 15"):
            I.backfill(store, some, known, from_block=1)
        with pytest.raises(D.MissingHeaders):
            D.require_headers(some, known)
    foreign = spark.createDataFrame([("0x" + "01" * 20, ["0x" + "ab" * 32, A, B], "0x", 15, "0x09", 0, 0)], RAW_LOG_SCHEMA)
    D.require_headers(foreign, known)
    assert store.read().count() == 0 and store.last_processed_block() == 0
    assert [(r.status, r.error_type, r.missing_block) for r in store.batch_log().orderBy("started_at").collect()][0] == ("error", "MissingHeaders", 1)
    assert I.backfill(store, logs, known, from_block=1, missing="quarantine") == 1
    assert [(r.tx_hash, r.block_number) for r in store.quarantined(RAW_LOG_SCHEMA).collect()] == [("0x02", 15)]
    assert store.last_processed_block(1) == 14  # progress stops before the gap
    assert I.poll_once(store, logs, header_rows(spark, range(1, 21)), start_block=1, batch_blocks=100) == (15, 20)
    assert store.read().count() == 2 and store.last_processed_block(1) == 20


def test_stream_takes_headers_that_arrive_while_it_waits(spark, scratch):
    src, headers, ckpt = scratch("late-src"), scratch("late-headers"), scratch("late-ckpt")
    store = TransferStore(spark, scratch("late-store"))
    raw(spark, [(1, 5, "0x01", 0)]).coalesce(1).write.mode("append").parquet(src)
    raw(spark, [(2, 15, "0x02", 0)]).coalesce(1).write.mode("append").parquet(src)
    header_rows(spark, range(1, 11)).write.parquet(headers)
    blocks = lambda: spark.read.schema(BLOCK_SCHEMA).parquet(headers)
    with pytest.raises(StreamingQueryException, match="MissingHeaders"):
        I.stream_ingest(spark, src, blocks, store, ckpt, start_block=1).awaitTermination()
    assert store.read().count() == 1 and store.last_processed_block(1) == 5
    header_rows(spark, range(11, 21)).write.mode("append").parquet(headers)
    I.stream_ingest(spark, src, blocks, store, ckpt, start_block=1).awaitTermination()
    assert store.read().count() == 2 and store.last_processed_block(1) == 15


def test_forced_restart_runs_to_the_head_each_time(spark, scratch):
    store, heads = TransferStore(spark, scratch("forced")), header_rows(spark, range(1, 34))
    first = raw(spark, [(v, b, "0x%02x" % b, 0) for v, b in enumerate(range(1, 30, 3))])
    I.backfill(store, first, heads, 1)
    late = first.unionByName(raw(spark, [(99, 4, "0xa1", 0), (98, 33, "0xa2", 0)]))
    assert I.forced_restart(store, late, heads, 1, batch_blocks=10) == [(1, 10), (11, 20), (21, 30), (31, 33)]
    later = late.unionByName(raw(spark, [(97, 4, "0xa3", 0)]))
    I.forced_restart(store, later, heads, 1, batch_blocks=10)
    assert store.read().count() == 13
    I.forced_restart(store, later, heads, 1, batch_blocks=40)
    assert store.read().count() == 13 and store.last_processed_block(1) == 33


def test_checkpoint_reset_takes_new_files(spark, scratch):
    src, ckpt = scratch("reset-src"), scratch("reset-ckpt")
    store, heads = TransferStore(spark, scratch("reset-store")), header_rows(spark, range(1, 50))
    raw(spark, [(1, 5, "0x01", 0)]).coalesce(1).write.mode("append").parquet(src)
    I.stream_ingest(spark, src, heads, store, ckpt + "/c").awaitTermination()
    os.rename(ckpt + "/c", ckpt + "/old")  # the same path again, as after a reset
    raw(spark, [(2, 6, "0x02", 0)]).coalesce(1).write.mode("append").parquet(src)
    I.stream_ingest(spark, src, heads, store, ckpt + "/c").awaitTermination()
    assert store.read().count() == 2


def test_progress_has_no_gaps(spark, scratch):
    store, heads = TransferStore(spark, scratch("gaps")), header_rows(spark, range(1, 41))
    src = scratch("gaps-src")
    raw(spark, [(1, 30, "0x30", 0)]).coalesce(1).write.parquet(src)
    I.stream_ingest(spark, src, heads, store, scratch("gaps-ckpt")).awaitTermination()
    assert store.read().count() == 1 and store.last_processed_block(1) == 0
    logs = raw(spark, [(1, 30, "0x30", 0), (2, 7, "0x07", 0)])
    assert I.poll_once(store, logs, heads, start_block=1, batch_blocks=20) == (1, 20)
    I.ingest_range(store, logs, heads, 31, 40, "ahead")
    assert store.last_processed_block(1) == 20
    assert I.poll_once(store, logs, heads, start_block=1, batch_blocks=10) == (21, 30)
    assert store.last_processed_block(1) == 40 and store.read().count() == 2


def test_two_writers_cannot_commit_the_same_key(spark, scratch):
    root, heads = scratch("two"), header_rows(spark, range(1, 50))
    one, two = TransferStore(spark, root), TransferStore(spark, root)
    logs = raw(spark, [(1, 5, "0x01", 0)])
    seen = two.last_seq
    two.last_seq = lambda: 0  # compared with the store before the first writer committed
    assert I.backfill(one, logs, heads, 1, run_id="one") == 1
    two.is_committed = lambda _: False
    with pytest.raises(ConcurrentCommit):
        I.backfill(two, logs, heads, 1, run_id="two")
    two.last_seq = seen
    assert I.backfill(two, logs, heads, 1, run_id="two") == 0
    assert one.read().count() == 1


def test_crash_between_entry_and_move(spark, scratch, monkeypatch):
    store, heads = TransferStore(spark, scratch("half")), header_rows(spark, range(1, 50))
    monkeypatch.setattr(store, "_settle", lambda entry: (_ for _ in ()).throw(OSError("killed")))
    monkeypatch.setattr(store, "record_failure", lambda *a: None)
    with pytest.raises(OSError):
        I.backfill(store, raw(spark, [(1, 5, "0x01", 0)]), heads, 1, run_id="r")
    again = TransferStore(spark, store.root)
    assert again.read().count() == 1 and again.is_committed("r-000000000001-000000000049")


def test_entries_are_rolled_up(spark, scratch, monkeypatch):
    monkeypatch.setattr("tokenlake.operators.store.GENERATION", 3)
    store, heads = TransferStore(spark, scratch("rolled")), header_rows(spark, range(1, 50))
    for k in range(7):
        I.ingest_range(store, raw(spark, [(k, k + 1, "0x%02x" % k, 0)]), heads, k + 1, k + 1, f"b{k}")
    assert store.fs.names(f"{store.root}/_rollup") == ["upto=000000000003", "upto=000000000006"]
    assert [r.batch for r in store.committed().orderBy("seq").collect()] == [f"b{k}" for k in range(7)]
    assert store.last_processed_block() == 7 and store.batch_log().count() == 7
    read = store.entries().inputFiles()
    assert not any("gen=000000000" in f and f.endswith(tuple(f"{n:012d}.json" for n in range(1, 7))) for f in read)


def test_files_are_sorted_and_prune_by_token(spark, scratch):
    store, heads = TransferStore(spark, scratch("layout")), header_rows(spark, range(1, 50))
    rows = [("0x%040x" % (v * 7919 % 500), [TRANSFER_TOPIC, A, B], "0x" + format(v, "064x"), 1 + v % 40, "0x%05x" % v, 0, 0) for v in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.backfill(store, spark.createDataFrame(rows, RAW_LOG_SCHEMA), heads, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = []
    for path, _, _ in store.fs.statuses(f"{store.root}/data"):
        if path.endswith(".parquet"):
            table = pq.read_table(path.removeprefix("file:"), columns=["token", "block_number"]).to_pylist()
            keys_ = [(r["token"], r["block_number"]) for r in table]
            assert keys_ == sorted(keys_)
            stats = pq.ParquetFile(path.removeprefix("file:")).metadata.row_group(0).column(1).statistics
            spans.append((stats.min, stats.max))
    assert len(spans) >= 4
    token = "0x%040x" % 250
    assert sum(lo <= token <= hi for lo, hi in spans) <= 2  # a token lies in one file's range, or at the edge of two


def test_bounds_above_int64(spark, scratch):
    store = TransferStore(spark, scratch("bounds"))
    I.backfill(store, raw(spark, [(1, 5, "0x01", 0)]), blocks(spark), 1)
    page = lambda **q: Q.filtered(store.read(), parse_params(q)).count()
    big = str(2**64 - 1)
    assert page(start_block=big) == 0 and page(end_block=big) == 1 and page(start_block="1", end_block=big) == 1


def test_changed_folder_table_gives_fresh_results(spark, scratch):
    root = scratch("tables")
    spark.range(3).write.parquet(f"{root}/lineitem.parquet")
    before = L.fingerprint(spark, root)
    assert before == L.fingerprint(spark, root)
    spark.range(4).write.mode("append").parquet(f"{root}/lineitem.parquet")
    assert L.fingerprint(spark, root) != before


def test_two_times_for_one_block_fail_or_are_kept_aside(spark, scratch):
    """Equal repeats of a header collapse; a block with two different times has none."""
    twice = blocks(spark).unionByName(blocks(spark)).unionByName(spark.createDataFrame([(6, 0)], BLOCK_SCHEMA))
    logs = raw(spark, [(1, 5, "0x01", 0), (2, 6, "0x02", 0), (3, 7, "0x03", 0)])
    store = TransferStore(spark, scratch("conflict"))
    with pytest.raises(D.MissingHeaders):
        I.ingest_range(store, logs, twice, 1, 10, "b-1")
    assert store.read().count() == 0 and store.last_processed_block() == 0
    aside = TransferStore(spark, scratch("conflict-aside"))
    assert I.ingest_range(aside, logs, twice, 1, 10, "b-1", missing="quarantine") == 2
    assert [r.block_number for r in aside.quarantined(RAW_LOG_SCHEMA).collect()] == [6] and aside.last_processed_block() == 5


def test_head_may_be_a_block_without_header(spark, scratch):
    store = TransferStore(spark, scratch("head"))
    logs, known = raw(spark, [(1, 5, "0x01", 0)]), blocks(spark).where("block_number <= 5")
    done = []
    while (r := I.poll_once(store, logs, known, start_block=1, batch_blocks=4, head=9)) is not None:
        done.append(r)
    assert done == [(1, 4), (5, 8), (9, 9)] and store.last_processed_block(1) == 9
    assert store.read().first().timestamp.timestamp() == 5000


def row_groups(spark, files, column, value, bloom=True, dictionary=True):
    """(row groups, those left for ``column = value``) as the Parquet reader decides from footers, dictionaries and filters."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    api, parquet = jvm.org.apache.parquet.filter2.predicate.FilterApi, jvm.org.apache.parquet
    wanted = parquet.filter2.compat.FilterCompat.get(api.eq(api.binaryColumn(column), parquet.io.api.Binary.fromString(value)))
    counts = [0, 0]
    for f in files:
        source = parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
        asked = parquet.HadoopReadOptions.builder(conf).withRecordFilter(wanted).useBloomFilter(bloom).useDictionaryFilter(dictionary).build()
        for k, options in enumerate((parquet.HadoopReadOptions.builder(conf).build(), asked)):
            reader = parquet.hadoop.ParquetFileReader.open(source, options)
            counts[k] += reader.getRowGroups().size()
            reader.close()
    return tuple(counts)


@pytest.fixture()
def many_files(spark):
    """Settings under which a write of the layout gives 24 files, without dictionaries as in row groups of many values."""
    wanted = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "parquet.enable.dictionary": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_senders_and_receivers_skip_row_groups(spark, scratch, many_files):
    """F2/F3 on a store of 24 files: Bloom filters leave few more row groups than hold the address."""
    from tokenlake.operators.store import write_layout
    from tokenlake.plans import views as V

    rows = V.deduped_transfers(spark, "/root/testdata/sf0.01")
    # senders as rare as on a chain: one of 3,000 each, anywhere in the token order
    rows = rows.withColumn("from", F.concat(F.lit("0x"), F.sha1(F.pmod(F.xxhash64("tx_hash", "log_index"), F.lit(3000)).cast("string"))))
    path = scratch("bloom")
    write_layout(rows, path)
    stored = spark.read.parquet(path)
    files = stored.inputFiles()
    assert len(files) >= 20
    for column, places in (("from", 40), ("to", 40)):
        for (value,) in stored.select(column).distinct().orderBy(F.xxhash64(column)).limit(5).collect():
            holding = stored.where(F.col(column) == value).select(F.input_file_name()).distinct().count()
            total, left = row_groups(spark, files, column, value)
            without = row_groups(spark, files, column, value, bloom=False)[1]
            assert holding <= left <= holding + 2 and left < total, (column, holding, left, total)
            assert without > left or column == "to", (column, without, left)
    # the query pushes the equality that the reader decides by
    plan = stored.where(F.col("from") == value)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(from," in plan


def test_key_index_buckets(spark, scratch):
    """K1: a batch reads the buckets it touches, from the index and from commits that are not in it yet."""
    from tokenlake.operators.store import KEY_BUCKETS, bucket_mask, buckets_of, key_bucket

    store = TransferStore(spark, scratch("keys"), open_commits=2)
    for k in range(5):
        rows = [(v, 1 + k, "0x%02x" % (10 * k + v), v % 3) for v in range(10)]
        assert I.ingest_range(store, raw(spark, rows), blocks(spark), k + 1, k + 1, f"b-{k}") == 10
    for kind in ("keys", "summaries"):
        assert store.fs.names(f"{store.root}/{kind}") == ["after=000000000000", "after=000000000002"] and store.indexed_upto(kind) == 4
    every = {(r.tx_hash, r.log_index) for r in store.keys().collect()}
    assert every == {(r.tx_hash, r.log_index) for r in store.read().collect()} and store.keys().count() == 50
    # one transaction, one bucket: only its folder, in the index and in the open commit
    one = raw(spark, [(7, 40, "0x07", 1), (9, 40, "0x07", 2)]).select("tx_hash")
    (bucket,) = buckets_of(one.agg(bucket_mask(F.col("tx_hash"))).first()[0])
    some = store.keys([bucket])
    assert {r.kb for r in some.collect()} == {bucket} and some.count() < 50
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(kb" in plan or "PartitionFilters: [kb" in plan
    # a key comes back in another block; replays of everything add nothing
    assert I.ingest_range(store, raw(spark, [(7, 40, "0x07", 1), (9, 40, "0x07", 2)]), blocks(spark), 40, 40, "again") == 1
    rows = [(v, 1 + k, "0x%02x" % (10 * k + v), v % 3) for v in range(10) for k in range(5)]
    assert I.ingest_range(store, raw(spark, rows), blocks(spark), 1, 5, "replay") == 0
    assert buckets_of(-1) == list(range(KEY_BUCKETS)) and buckets_of(None) == []
    assert spark.range(1000).select(key_bucket(F.col("id").cast("string")).alias("b")).distinct().count() == KEY_BUCKETS


def test_headers_are_read_for_the_batch_only(spark, scratch):
    """The batch's block bounds reach the header scan."""
    path = scratch("headers")
    blocks(spark).repartitionByRange(5, "block_number").write.parquet(path)
    heads = I.headers_between(spark.read.schema(BLOCK_SCHEMA).parquet(path), 5, 9)
    p = D.attach_block_time(raw(spark, [(1, 5, "0x01", 0)]), heads)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_number,5), LessThanOrEqual(block_number,9)" in p
    assert I.headers_between(blocks(spark), None, None).count() == 0


def test_the_source_is_read_once(spark, scratch):
    """One scan of the batch, its staged records are gone afterwards, and reading the store writes nothing."""
    src, seen = scratch("once"), spark.sparkContext.accumulator(0)
    raw(spark, [(v, 1 + v % 9, "0x%02x" % v, 0) for v in range(50)]).write.parquet(src)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    logs = spark.createDataFrame(spark.read.parquet(src).rdd.mapPartitions(counted), RAW_LOG_SCHEMA)
    store = TransferStore(spark, scratch("once-store"))
    assert I.ingest_range(store, logs, blocks(spark), 1, 9, "b-1") == 50 and seen.value == 50
    assert not store.fs.names(store.root + "/_staging")
    before = store.fs.statuses(store.root)
    assert store.read().count() == 50 and store.is_committed("b-1") and store.last_processed_block() == 9
    assert store.fs.statuses(store.root) == before


def test_failure_keeps_its_error(spark, scratch, monkeypatch):
    """O1: another writer takes the entry's number; the failure is recorded after it and the real error is raised."""
    store = TransferStore(spark, scratch("error"))
    real, taken = TransferStore._append, []

    def append(self, entry, seq):
        if not taken:
            taken.append(seq)
            raise ConcurrentCommit("taken")
        return real(self, entry, seq)

    monkeypatch.setattr(TransferStore, "_append", append)
    with pytest.raises(D.MissingHeaders):
        I.ingest_range(store, raw(spark, [(1, 99, "0x01", 0)]), blocks(spark), 90, 99, "b-1")
    assert [r.status for r in store.batch_log().collect()] == ["error"]


def test_feed_after_a_position(spark, scratch):
    store = TransferStore(spark, scratch("feed-after"))
    for k in range(3):
        I.ingest_range(store, raw(spark, [(v, 1 + k, "0x%02x" % (10 * k + v), v % 2) for v in range(6)]), blocks(spark), k + 1, k + 1, f"b-{k}")
    everything = [tuple(r)[:4] for r in store.feed_after(limit=100).collect()]
    assert len(everything) == 18
    for n in (0, 1, 5, 6, 11, 17):
        assert [tuple(r)[:4] for r in store.feed_after(everything[n], 4).collect()] == everything[n + 1 : n + 5]


def test_progress_over_merged_runs(spark, scratch, monkeypatch):
    """Ranges in any order, with gaps that close later, over several roll-ups; few rows reach the window."""
    from tokenlake.operators import store as ST

    monkeypatch.setattr(ST, "GENERATION", 4)
    store = TransferStore(spark, scratch("runs"))
    marks = [(5, 9), (1, 2), (20, 22), (3, 4), (23, 30), (15, 16), (10, 14), (17, 19), (40, 41), (1, 3), (31, 39)]
    for k, (lo, hi) in enumerate(marks):
        store.mark_processed((lo, hi), f"m{k}")
        done = {b for a, z in marks[: k + 1] for b in range(a, z + 1)}
        for start in (1, 5, 20):
            want = next(b for b in range(start, 99) if b not in done) - 1
            assert store.last_processed_block(start) == (want if want >= start else 0), (k, start)
    assert store.fs.names(store.root + "/_runs") == ["upto=000000000004", "upto=000000000008"]
    assert store._covered().count() == 1 + 3  # one run up to entry 8, and three entries after it
    rows = [(1, 2), (2, 5), (7, 8), (8, 8), (10, 11), (3, 4)]
    entries = spark.createDataFrame([(a, z, "ok") for a, z in rows] + [(50, 60, "error"), (None, None, "ok")], "covered_from long, covered_to long, status string")
    assert sorted(tuple(r)[:2] for r in ST.covered_runs(entries).select("covered_from", "covered_to").collect()) == [(1, 5), (7, 8), (10, 11)]


def test_late_writer_cannot_index_commits_twice(spark, scratch, monkeypatch):
    """Two writers index at once: the one whose starting point is taken publishes nothing, so no summary counts twice."""
    root = scratch("index-race")
    store, other = TransferStore(spark, root), TransferStore(spark, root)
    for k in range(3):
        I.ingest_range(store, raw(spark, [(k, k + 1, f"0x0{k}", 0)]), blocks(spark), k + 1, k + 1, f"b-{k}")
    monkeypatch.setattr(store, "last_seq", lambda: 2)  # it has not seen the third commit
    monkeypatch.setattr(other, "indexed_upto", lambda kind="keys": 0)  # it has not seen the first one's folders
    store.index_commits()
    other.index_commits()
    late = TransferStore(spark, root)
    assert late.indexed_upto("keys") == late.indexed_upto("summaries") == 2
    assert late.keys().count() == 3 and late.summaries()[0].agg(F.sum("n")).first()[0] == 2
