"""T3 by counted ranges: every page equals a slice of the sorted rows, and only the range of the offset is kept."""

import random

import pytest
from pyspark.sql import functions as F

from tokenlake.functions.params import TransferQueryParams
from tokenlake.operators import paging as PG
from tokenlake.operators import query as Q

SCHEMA = "block_number long, block_bucket long, log_index int, tx_hash string, token string, `from` string, `to` string, timestamp timestamp"


def rows(n=3000, hot=0.4):
    """Blocks of several buckets; one block holds a large part, most of it under one log index."""
    rng, seen = random.Random(7), set()
    while len(seen) < n:
        block = 250_123 if rng.random() < hot else rng.choice([5, 99_999, 100_000, 250_122, 250_124, 399_999]) + rng.randint(0, 40)
        log = 3 if block == 250_123 and rng.random() < 0.9 else rng.randint(0, 6)
        seen.add((block, log, "0x" + ("ab" * 20 if rng.random() < 0.5 else "cd" * 20) + format(rng.getrandbits(96), "024x")))
    return [(b, b // 100_000, li, tx, "t" + str(b % 3), "f", "r", None) for b, li, tx in seen]


def key(r):
    return (-r[0], r[2], r[3])


@pytest.fixture(scope="module")
def table(spark):
    data = rows()
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache(), sorted(data, key=key)


@pytest.mark.parametrize("offset", [0, 1, 99, 700, 1234, 1500, 2100, 2899, 2950, 2999, 3000, 10_000])
def test_page_equals_slice(table, offset):
    df, want = table
    got = PG.page_deep(df, TransferQueryParams(offset=offset), range_rows=20).collect()
    assert [(r.block_number, r.log_index, r.tx_hash) for r in got] == [(r[0], r[2], r[3]) for r in want[offset : offset + 100]]


def test_filtered_page(table):
    df, want = table
    want = [r for r in want if r[4] == "t1"]
    got = PG.page_deep(df, TransferQueryParams(token="t1", offset=len(want) // 2, limit=7), range_rows=5).collect()
    assert [r.tx_hash for r in got] == [r[3] for r in want[len(want) // 2 :][:7]]


@pytest.mark.parametrize(("offset", "range_rows"), [(1234, 20), (1500, 20), (2999, 20), (1500, 5000)])
def test_kept_rows_are_one_range_and_the_page(table, offset, range_rows):
    """What is left to sort: the range with the offset and the page behind it, not what lies before."""
    df, want = table
    kept, skip = PG.locate(df, offset, 100, range_rows)
    found = df.where(kept).collect()
    assert skip < range_rows
    first = want[offset - skip]
    assert all(key(r) >= key(first) for r in found)
    if range_rows < 100:  # the page's end lies in a block of its own or in the hot one, whose tail is cut by the top-k
        ends = {r[0] for r in want[offset : offset + 100]}
        assert {r.block_number for r in found} <= ends


def test_long_common_prefixes(spark):
    """A block whose hashes differ in the last digits only needs all prefix levels."""
    data = [(1, 0, 0, "0x" + format(i, "064x"), "t", "f", "r", None) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    got = PG.page_deep(df, TransferQueryParams(offset=257, limit=20), range_rows=4).collect()
    assert [int(r.tx_hash, 16) for r in got] == list(range(257, 277))


def test_bounds_reach_the_scan(spark, scratch):
    path = scratch("paged")
    spark.createDataFrame(rows(), SCHEMA).write.partitionBy("block_bucket").parquet(path)
    df = spark.read.schema(SCHEMA).parquet(path)
    kept, skip = PG.locate(df, 2100, 100, 50)
    p = df.where(kept).orderBy(*Q.listing_order()).offset(skip).limit(100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p and "PartitionFilters: [isnotnull(block_bucket" in p
    assert "LessThanOrEqual(block_number," in p
    assert df.where(kept).select(F.countDistinct("block_bucket")).first()[0] == 1
