import json

from pyspark.sql import functions as F

from tokenlake.operators.store import TransferStore
from tokenlake.schemas import BLOCK_SCHEMA, RAW_LOG_SCHEMA, TRANSFER_TOPIC
from tokenlake.streaming import ingest as I

A = "0x" + "00" * 12 + "aa" * 20
B = "0x" + "00" * 12 + "bb" * 20
DAY = 86400


def raw(spark, rows):
    return spark.createDataFrame(
        [("0x" + "01" * 20, [TRANSFER_TOPIC, A, B], "0x" + format(v, "064x"), blk, tx, 0, li) for v, blk, tx, li in rows],
        RAW_LOG_SCHEMA,
    )


def test_dedup_tx_within_24h(spark, scratch):
    # block b has time b * 12 h; one file per micro-batch
    blocks = spark.createDataFrame([(b, b * DAY // 2) for b in range(1, 20)], BLOCK_SCHEMA)
    src = scratch("r6-src")
    files = [
        [(1, 2, "0x01", 0), (2, 2, "0x01", 1)],  # same batch: one kept
        [(3, 3, "0x01", 2)],  # 12 h later: duplicate
        [(4, 10, "0x01", 3), (5, 10, "0x02", 0)],  # 4 days later, but the watermark still trails: dropped
        [(6, 15, "0x03", 0)],  # moves the watermark past the first 0x01 + 24 h
        [(7, 16, "0x01", 4)],  # state expired: kept again
    ]
    for f in files:
        raw(spark, f).coalesce(1).write.mode("append").parquet(src)
    out = scratch("r6-out")
    q = I.dedup_tx_within(spark, src, blocks, out, scratch("r6-ckpt"))
    q.awaitTermination()
    got = sorted((r.tx_hash, r.block_number) for r in spark.read.parquet(out).collect())
    assert got == [("0x01", 2), ("0x01", 16), ("0x02", 10), ("0x03", 15)]


def test_feed_json_keys_and_batch_log(spark, scratch):
    blocks = spark.createDataFrame([(b, 1000 * b) for b in range(1, 50)], BLOCK_SCHEMA)
    store = TransferStore(spark, scratch("feed-store"))
    rows = [(10**30 + 7, 5, "0x01", 0), (2, 5, "0x01", 0), (3, 6, "0x02", 1)]
    bad = spark.createDataFrame([("0x" + "01" * 20, [TRANSFER_TOPIC, A], "0x", 7, "0x03", 0, 0)], RAW_LOG_SCHEMA)
    logs = raw(spark, rows).unionByName(bad)
    assert I.ingest_range(store, logs, blocks, 1, 10, "b-1") == 2
    rec = json.loads(store.feed().orderBy("tx_hash").first().json)
    assert list(rec) == ["event_signature", "token", "from", "to", "value", "value_string", "value_decimal",
                         "block_number", "tx_hash", "tx_index", "log_index", "timestamp", "created_at"]
    assert rec["value"] == "2" and rec["event_signature"] == "Transfer" and rec["timestamp"] == "1970-01-01T01:23:20Z"
    log = store.batch_log().first()
    assert (log.from_block, log.to_block, log.rows_read, log.rejected_topic_count, log.accepted, log.inserted,
            log.duplicates) == (1, 10, 4, 1, 3, 2, 1)
    assert I.slow_batches(store.batch_log(), poll_interval_s=1e9).first().slow is False
    assert store.progress().select(F.max("block_number")).first()[0] == 10


def test_feed_published_through_a_stream(spark, scratch):
    from tokenlake.streaming.feed import publish_feed, read_feed

    blocks = spark.createDataFrame([(b, 1000 * b) for b in range(1, 50)], BLOCK_SCHEMA)
    store = TransferStore(spark, scratch("pub-store"))
    out, ckpt = scratch("pub-out"), scratch("pub-ckpt")
    I.ingest_range(store, raw(spark, [(1, 5, "0x01", 0), (2, 6, "0x02", 0)]), blocks, 1, 10, "b-1")
    publish_feed(spark, store, out, ckpt).awaitTermination()
    I.ingest_range(store, raw(spark, [(3, 15, "0x03", 0), (4, 16, "0x01", 0)]), blocks, 11, 20, "b-2")
    publish_feed(spark, store, out, ckpt).awaitTermination()
    publish_feed(spark, store, out, ckpt).awaitTermination()  # nothing new: no-op
    got = sorted((r.seq, json.loads(r.json)["tx_hash"]) for r in read_feed(spark, out).collect())
    assert got == [(1, "0x01"), (1, "0x02"), (2, "0x03")]
