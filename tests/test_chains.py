"""R6 as a function of the data: against the sequential rule, and the same for any cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import chains as CH

SCHEMA = "id long, key string, ts timestamp_ntz"
START = datetime(2024, 1, 1)
HOUR = 3600 * 1_000_000


def make(n, keys, hours, seed, hot=0.0):
    rng = random.Random(seed)
    at = lambda: START + timedelta(seconds=rng.randint(0, hours * 12) * 300)  # noqa: E731  many equal times
    return [(i, "hot" if rng.random() < hot else rng.choice(keys), at()) for i in range(n)]


def sequential(rows, horizon):
    last, kept = {}, []
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts is not None and (key not in last or ts - last[key] >= horizon):
            last[key] = ts
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize(("n", "keys", "hours", "hot"), [(400, ["a", "b", "c", None], 200, 0.0), (600, ["a", "b"], 1000, 0.9), (50, ["a"], 1, 0.0), (1, ["a"], 1, 0.0)])
def test_equals_the_sequential_rule(spark, n, keys, hours, hot):
    rows = make(n, keys, hours, n, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(r.id for r in CH.keep_chain(df, "key", "ts", ["id"]).collect())
    assert got == sequential(rows, timedelta(hours=24))


def test_exact_horizon_and_empty(spark):
    rows = [(1, "a", START), (2, "a", START + timedelta(hours=24, microseconds=-1)), (3, "a", START + timedelta(hours=24)), (4, "b", datetime(1969, 12, 30, 1)),
            (5, "b", datetime(1969, 12, 31, 0, 59, 59)), (6, "b", datetime(1969, 12, 31, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in CH.keep_chain(df, "key", "ts", ["id"]).collect()) == [1, 3, 4, 6]
    assert CH.keep_chain(df.where("false"), "key", "ts", ["id"]).count() == 0
    with pytest.raises(ValueError, match="positive"):
        CH.keep_chain(df, "key", "ts", ["id"], 0)


@pytest.mark.parametrize("files_per_trigger", [8, 2, 1])
def test_same_output_for_any_micro_batches(spark, scratch, files_per_trigger):
    rows = sorted(make(400, list("abcdef"), 300, 5, 0.3), key=lambda r: r[2])
    src, step = scratch("chain-src"), 300 * 3600 / 8
    for k in range(8):
        part = [r for r in rows if min(int((r[2] - START).total_seconds() // step), 7) == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    out, checkpoint = scratch("chain-out"), scratch("chain-ckpt")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    q = CH.keep_chain_stream(spark, stream, out, checkpoint, "key", "ts", ["id"], horizon_us=7 * HOUR)
    q.awaitTermination()
    assert len(q.recentProgress) >= 8 // files_per_trigger
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sequential(rows, timedelta(hours=7))
    # the state: one time per key of the last horizon
    last = spark.read.parquet(f"{checkpoint}/marks/batch={8 // files_per_trigger - 1}")
    assert last.count() <= 7 and last.select(F.countDistinct("key")).first()[0] == last.count()


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """600 kept rows in one chain: jumps of 1, 2, 4, ... 512."""
    names = []
    real = CH.written
    monkeypatch.setattr(CH, "written", lambda df, name: names.append(name) or real(df, name))
    df = spark.range(600).select(F.col("id"), F.lit("a").alias("key"), (F.lit(START) + F.make_dt_interval(F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    assert CH.keep_chain(df, "key", "ts", ["id"]).count() == 600
    assert names.count("chain-jumps") <= 12
