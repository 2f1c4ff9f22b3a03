from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tokenlake.functions.params import TransferQueryParams, clamp, effective_limit, parse_params, parse_rfc3339
from tokenlake.operators import decode as D
from tokenlake.operators import query as Q
from tokenlake.schemas import BLOCK_SCHEMA, RAW_LOG_SCHEMA, TRANSFER_TOPIC, VALUE_PARTS_TYPE

A = "0x" + "00" * 12 + "aa" * 20
B = "0x" + "00" * 12 + "bb" * 20
C = "0x" + "00" * 12 + "cc" * 20


@pytest.fixture(scope="module")
def transfers(spark):
    rows = []
    for b in range(1, 31):
        for li in range(3):
            src, dst = (A, B) if li % 2 == 0 else (B, C)
            tok = "0x" + format(b % 4, "040x")
            rows.append((tok, [TRANSFER_TOPIC, src, dst], "0x" + format(b * 10**18 + li, "064x"), b,
                         "0x" + format(b, "064x"), 0, li))
    rows.append(("0x" + format(1, "040x"), [TRANSFER_TOPIC, A, B], "0x" + "f" * 64, 31, "0x" + "ee" * 32, 0, 0))
    raw = spark.createDataFrame(rows, RAW_LOG_SCHEMA)
    blocks = spark.createDataFrame([(b, 86400 * b) for b in range(1, 32)], BLOCK_SCHEMA)
    return D.transfers_from_raw(raw, blocks).cache()


def test_limit_clamp():
    assert [effective_limit(x) for x in (0, -1, 100, 1000, 1001)] == [100, 100, 100, 1000, 1000]
    with pytest.raises(ValueError):
        clamp(TransferQueryParams(offset=-1))


def test_lenient_parse():
    p = parse_params({"limit": "abc", "offset": "5", "start_time": "2024-01-01", "end_time": "2024-01-02T00:00:00Z",
                      "start_block": "-3", "end_block": "17", "token": "0xAb"})
    assert p.limit == 100 and p.offset == 5 and p.start_time is None and p.start_block is None
    assert p.end_block == 17 and p.token == "0xAb"
    assert p.end_time == datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert parse_rfc3339("2024-01-01T10:00:00+02:00") == datetime(2024, 1, 1, 8, tzinfo=timezone.utc)


def test_block_bounds_inclusive(transfers):
    got = Q.filtered(transfers, TransferQueryParams(start_block=5, end_block=5)).collect()
    assert {r.block_number for r in got} == {5} and len(got) == 3


def test_time_bounds_inclusive(transfers):
    t = datetime.fromtimestamp(86400 * 7, tz=timezone.utc)
    got = Q.filtered(transfers, TransferQueryParams(start_time=t, end_time=t)).collect()
    assert {r.block_number for r in got} == {7}


def test_address_filters_exact_case(transfers):
    b = "0x" + "bb" * 20
    mixed = "0x" + "Bb" * 20
    assert Q.filtered(transfers, TransferQueryParams(from_=b)).count() == 30
    assert Q.filtered(transfers, TransferQueryParams(to=b)).count() == 61
    assert Q.filtered(transfers, TransferQueryParams(from_=mixed)).count() == 0
    assert Q.filtered(transfers, TransferQueryParams(from_=mixed), normalize=True).count() == 30


def test_page_order_offset_and_total(transfers):
    page = Q.page(transfers, TransferQueryParams(limit=4, offset=2)).collect()
    assert [(r.block_number, r.log_index) for r in page] == [(30, 1), (30, 2), (29, 0), (29, 1)]
    assert Q.page(transfers, TransferQueryParams(offset=10_000)).count() == 0
    listing = Q.list_transfers(transfers, TransferQueryParams(limit=5000, offset=10_000))
    assert listing.total == 91 and listing.limit == 5000  # echoed unclamped
    plan = Q.page(transfers, TransferQueryParams())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_keyset_paging_matches_offset(transfers):
    first = Q.page(transfers, TransferQueryParams(limit=7)).collect()
    last = first[-1]
    nxt = Q.page_after(transfers, TransferQueryParams(limit=7), (last.block_number, last.log_index, last.tx_hash))
    off = Q.page(transfers, TransferQueryParams(limit=7, offset=7))
    assert [r.tx_hash + str(r.log_index) for r in nxt.collect()] == [r.tx_hash + str(r.log_index) for r in off.collect()]


def test_aggregates_and_wide_value(transfers):
    a = Q.aggregates(transfers).first()
    assert a.total_transfers == 91
    expected = sum(b * 10**18 + li for b in range(1, 31) for li in range(3))  # the wide value counts as 0
    assert a.total_value == str(expected)
    assert a.unique_tokens == 4 and a.unique_addresses == 3
    assert a.time_range.start.timestamp() == 86400 and a.time_range.end.timestamp() == 86400 * 31
    exact = Q.exact_total(transfers).first().exact_total
    assert int(exact) == expected + 2**256 - 1


def test_aggregates_empty(transfers):
    a = Q.aggregates(transfers, TransferQueryParams(token="0xNOPE")).first()
    assert (a.total_transfers, a.total_value, a.total_value_decimal, a.unique_tokens, a.unique_addresses) == (
        0, "", 0.0, 0, 0)
    assert a.time_range.start is None


def test_legacy_rows_sum_from_text(transfers):
    legacy = transfers.withColumns({"dec128_ok": F.lit(None).cast("boolean"), "value_parts": F.lit(None).cast(VALUE_PARTS_TYPE)})
    expected = sum(b * 10**18 + li for b in range(1, 31) for li in range(3)) + 2**256 - 1
    assert Q.aggregates(legacy).first().total_value == str(expected)


def test_partition_count_invariance(spark, transfers):
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(tuple(Q.aggregates(transfers).first()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_dedup_partition_count_invariance(spark, transfers):
    from tokenlake.operators import dedup as DD

    dup = transfers.unionByName(transfers.withColumn("block_number", F.col("block_number") + 100))
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted((r.tx_hash, r.log_index, r.block_number) for r in DD.dedup_transfers(dup).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2] and len(results[0]) == 91
    assert max(r[2] for r in results[0]) <= 31  # the earlier block won every key


def test_approx_distinct_option(transfers):
    exact = Q.aggregates(transfers).first()
    approx = Q.aggregates(transfers, approx=True).first()
    assert approx.total_value == exact.total_value and approx.total_transfers == exact.total_transfers
    assert abs(approx.unique_tokens - exact.unique_tokens) <= 1 and abs(approx.unique_addresses - exact.unique_addresses) <= 1
