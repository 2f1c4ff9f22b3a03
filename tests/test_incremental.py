"""Results that are kept up to date: streaks over micro-batches, summaries of commits, progress of streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_store import blocks, raw
from tokenlake.functions.params import TransferQueryParams
from tokenlake.operators import callstats as CS
from tokenlake.operators import query as Q
from tokenlake.operators import sketches as SK
from tokenlake.operators.store import TransferStore
from tokenlake.schemas import BLOCK_BUCKET_SIZE, BLOCK_SCHEMA
from tokenlake.streaming import ingest as I
from tokenlake.streaming import progress as PR
from tokenlake.streaming import streaks as STK

CALLS = "provider string, ts timestamp_ntz, seq long, ok boolean"


def calls(n, seed, fail=0.6):
    rng, at = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 40, 70]))
        provider = rng.choice("abc") if i < n // 2 else rng.choice("ac")  # b falls silent, d is always down
        out.append((provider if rng.random() < 0.9 else "d", at, i, rng.random() > fail))
    return [(p, t, i, ok and p != "d") for p, t, i, ok in out]


def runs(rows, threshold):
    """Maximal runs of failures per provider: (provider, first seq, last seq, length)."""
    out, open_ = [], {}
    for p, _, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        if ok:
            if p in open_:
                out.append((p, *open_.pop(p)))
        else:
            s, _, n = open_.get(p, (i, i, 0))
            open_[p] = (s, i, n + 1)
    out += [(p, *r) for p, r in open_.items()]
    return sorted(r for r in out if r[3] >= threshold)


def shown(df):
    return sorted((r.provider, r.start_seq, r.end_seq, r.length) for r in df.collect())


@pytest.mark.parametrize("cuts", [[0, 60, 61, 140, 200], [0, 5, 10, 200]])
def test_streaks_continue_over_parts(spark, cuts):
    rows = calls(200, 4)
    state, found = spark.createDataFrame([], CS.OPEN_RUN_SCHEMA), []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        ended, still = CS.continue_streaks(spark.createDataFrame(rows[lo:hi], CALLS), state, 3)
        found += shown(ended)
        state = spark.createDataFrame(still.collect(), CS.OPEN_RUN_SCHEMA)
    assert sorted(found + shown(CS.open_streaks(state, 3))) == runs(rows, 3)
    assert shown(CS.failure_streaks(spark.createDataFrame(rows, CALLS), 3)) == runs(rows, 3)


def test_streaks_as_a_stream(spark, scratch):
    rows = calls(120, 8, fail=0.8)
    src, out, ckpt = scratch("streak-src"), scratch("streak-out"), scratch("streak-ckpt")
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], CALLS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(src)
    q = STK.streaks_stream(spark, stream, out, ckpt, 3)
    q.awaitTermination()
    assert shown(STK.streaks_so_far(spark, out, ckpt, 3, 3)) == runs(rows, 3)
    assert shown(STK.streaks_so_far(spark, out, ckpt, 1, 3)) == runs(rows[:60], 3)
    assert any(s // 30 != e // 30 for _, s, e, _ in runs(rows, 3))  # some span micro-batches


@pytest.fixture(scope="module")
def chain(spark):
    """A store of six commits over four block buckets; two commits are younger than the summaries."""
    from tokenlake.session import scratch_path

    store = TransferStore(spark, scratch_path(spark, "sketched"), open_commits=4)
    rng = random.Random(2)
    heads = spark.createDataFrame([(b, 1000 + b) for b in {k * 77_000 + d for k in range(6) for d in range(5)}], BLOCK_SCHEMA)
    for k in range(6):
        rows = [(rng.randint(0, 10**30), k * 77_000 + rng.randint(0, 4), f"0x{k}{v:03d}", 0) for v in range(40)]
        I.ingest_range(store, raw(spark, rows), heads, k * 77_000, k * 77_000 + 76_999, f"b-{k}")
    assert store.summaries()[1] == 4
    return store


@pytest.mark.parametrize(("lo", "hi"), [(None, None), (0, 99_999), (100_000, 299_999), (77_001, 231_003), (100_000, None), (None, 154_002), (5, 6), (2**63, None), (10, 5)])
def test_summaries_equal_rows(chain, lo, hi):
    p = TransferQueryParams(start_block=lo, end_block=hi)
    got, want = SK.aggregates(chain, p).first(), Q.aggregates(chain.read(), p).first()
    assert (got.total_transfers, got.total_value, got.total_value_decimal, got.time_range) == (want.total_transfers, want.total_value, want.total_value_decimal, want.time_range)
    for c in ("unique_tokens", "unique_addresses"):
        assert abs(got[c] - want[c]) <= SK.ERROR * want[c] + 1


def test_whole_buckets_read_no_rows(spark, chain):
    size = BLOCK_BUCKET_SIZE
    assert SK.whole_buckets(TransferQueryParams(start_block=size, end_block=3 * size - 1)) == (1, 2)
    assert SK.whole_buckets(TransferQueryParams(start_block=1, end_block=size)) == (1, 0)
    chain.index_commits()
    p = SK.aggregates(chain, TransferQueryParams())._jdf.queryExecution().executedPlan().toString()
    assert "summaries" in p and f"{chain.root}/data" not in p
    with pytest.raises(ValueError, match="block bounds"):
        SK.aggregates(chain, TransferQueryParams(token="0x01"))


def test_sketches_stay_within_their_error(spark):
    n = 60_000
    rows = spark.range(n).select(
        (F.col("id") % 7).alias("block_bucket"), F.sha1(F.col("id").cast("string")).alias("token"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("from"),
        F.concat(F.lit("r"), F.col("id") % 30_000).alias("to"), F.timestamp_seconds("id").alias("timestamp"), F.lit(None).cast("boolean").alias("dec128_ok"),
        F.lit("1").alias("value_string"), F.lit(None).cast("struct<" + ",".join(f"c{i}:bigint" for i in range(9)) + ">").alias("value_parts"),
    )
    one = SK.merge(SK.summarise(rows)).first()
    assert (one.total_transfers, one.total_value) == (n, str(n))
    assert abs(one.unique_tokens - n) <= SK.ERROR * n and abs(one.unique_addresses - 50_000) <= SK.ERROR * 50_000


def test_progress_of_a_stream_with_a_slow_batch(spark, scratch):
    """One row per micro-batch; the flag finds the slow one, the histogram counts them all."""
    import time

    src, path = scratch("progress-src"), scratch("progress")
    for k in range(3):
        raw(spark, [(1, 5 + k, f"0x{k}", 0)]).coalesce(1).write.mode("append").parquet(src)
    listener = PR.ProgressLog(spark, path)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(raw(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(src)
        slow = lambda batch, n: (batch.count(), time.sleep(6 if n == 1 else 0))
        q = stream.writeStream.foreachBatch(lambda b, n: slow(b, n) and None).option("checkpointLocation", scratch("progress-ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
        PR.wait_for(listener, 3)
    finally:
        spark.streams.removeListener(listener)
    progress = PR.read_progress(spark, path)
    assert sorted(r.batch for r in progress.collect()) == [0, 1, 2]
    flags = {r.batch: r.slow for r in I.slow_batches(progress, poll_interval_s=5.5).collect()}
    assert flags[1] and not flags[2]
    bars = {r.le: r.cumulative_count for r in CS.duration_histogram(progress, (5.5,)).collect()}
    assert bars["+Inf"] == 3 and bars["5.5"] in (1, 2)


def test_tx_dedup_fails_on_a_missing_header(spark, scratch):
    src = scratch("r6-missing")
    raw(spark, [(1, 5, "0x01", 0), (2, 99, "0x02", 0)]).coalesce(1).write.parquet(src)
    q = I.dedup_tx_within(spark, src, blocks(spark), scratch("r6-missing-out"), scratch("r6-missing-ckpt"))
    with pytest.raises(Exception, match="without a block header"):
        q.awaitTermination()
