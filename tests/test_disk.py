"""What queries leave on disk: the published feed is compressed in bounded files, and shuffle files go with their job."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tokenlake import session as S
from tokenlake.operators.store import TransferStore
from tokenlake.schemas import BLOCK_SCHEMA, RAW_LOG_SCHEMA, TRANSFER_TOPIC
from tokenlake.sources import landing as L
from tokenlake.streaming import feed as FD
from tokenlake.streaming import ingest as I

A = "0x" + "00" * 12 + "aa" * 20
B = "0x" + "00" * 12 + "bb" * 20


def stored(spark, root, n):
    """A store with one commit of n transfers of random-looking transactions."""
    ids = spark.range(n).withColumn("tx", F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)))
    logs = ids.selectExpr(f"'0x{'01' * 20}' address", f"array('{TRANSFER_TOPIC}', '{A}', '{B}') topics", "concat('0x', lpad(lower(hex(id)), 64, '0')) data",
                          "id % 9 + 1 block_number", "tx tx_hash", "0 tx_index", "0 log_index").to(RAW_LOG_SCHEMA)
    store = TransferStore(spark, root)
    I.ingest_range(store, logs, spark.createDataFrame([(b, 1000 * b) for b in range(1, 10)], BLOCK_SCHEMA), 1, 9, "b-1")
    return store


def published(spark, scratch, store):
    out = scratch("feed-out")
    FD.publish_feed(spark, store, out, scratch("feed-ckpt")).awaitTermination()
    files = [f for f in os.scandir(f"{out}/seq=1") if f.name.startswith("part-")]
    return sorted(r.json for r in FD.read_feed(spark, out).collect()), files


def test_the_feed_is_compressed(spark, scratch):
    store = stored(spark, scratch("feed-gz"), 2000)
    lines, files = published(spark, scratch, store)
    text = sum(len(x) + 1 for x in lines)
    assert len(lines) == 2000 and sum(f.stat().st_size for f in files) < text / 3
    assert lines == sorted(r.json for r in store.feed().collect())


def test_files_of_the_feed_are_bounded(spark, scratch, monkeypatch):
    monkeypatch.setattr(FD, "FILE_ROWS", 100, raising=False)
    lines, files = published(spark, scratch, stored(spark, scratch("feed-bounded"), 2000))
    assert len(lines) == len(set(lines)) == 2000
    assert all(spark.read.text(f.path).count() <= 100 for f in files) and len(files) >= 20


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in found for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def left_of(spark, before):
    """Shuffle files made since; Spark removes them in the background."""
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return left


def test_shuffle_files_of_a_scenario_go_with_their_job(spark, scratch):
    before, path, left = shuffle_files(spark), scratch("scenario"), []
    kept = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count()
    kept.collect()
    assert shuffle_files(spark) - before  # not in a scenario: they stay while the frame lives
    before = shuffle_files(spark)

    def write(p):
        for k in range(2):
            spark.range(20_000).repartitionByRange(4, F.hash("id")).sortWithinPartitions(F.hash("id")).write.parquet(f"{p}/{k}")
            left.append(left_of(spark, before))

    L.materialise(spark, path, write)
    assert left == [set(), set()] and spark.read.parquet(f"{path}/1").count() == 20_000
    assert S.SHUFFLE_CLEANUP not in spark.conf.getAll and len(kept.collect()) == 1000


def test_the_setting_of_the_session_comes_back(spark):
    s = spark.newSession()
    on = lambda: s.conf.get(S.SHUFFLE_CLEANUP)
    with pytest.raises(KeyError), S.shuffles_removed(s):
        with S.shuffles_removed(s):
            assert on() == "true"
        assert on() == "true"
        raise KeyError
    assert on() == "false" and S.SHUFFLE_CLEANUP not in s.conf.getAll
    s.conf.set(S.SHUFFLE_CLEANUP, "false")
    with S.shuffles_removed(s):
        assert on() == "false"
    assert on() == "false"
