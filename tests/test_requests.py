"""P17 and the listings over a table of requests, against the request-by-request functions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tokenlake.functions.params import build_filter, effective_limit, parse_params
from tokenlake.operators import query as Q
from tokenlake.operators import requests as RQ

SCHEMA = "request_id long, " + ", ".join(f"`{c}` string" for c in RQ.REQUEST_FIELDS)
TRANSFERS = "block_number long, log_index int, tx_hash string, token string, `from` string, `to` string, timestamp timestamp"

NUMBERS = [None, "", "0", "5", "+7", "-3", "abc", "12x", " 4", "1.5", "9223372036854775807", "9223372036854775808", "18446744073709551615",
           "18446744073709551616", "-9223372036854775809", "+", "-", "007", "99999999999999999999999999999999999999999999"]
TIMES = [None, "", "2024-01-01T00:00:00Z", "2024-01-01T02:30:00+02:30", "2024-01-01T00:00:00.5Z", "2023-12-31T00:01:00-23:59", "2024-01-01", "2024-13-01T00:00:00Z",
         "2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00", "2024-01-01t00:00:00Z", "2024-01-01T00:00:00+24:00", "2024-01-01T00:00:00+00:60",
         "2024-01-01T00:00:00.123456Z", "x"]


def request(i, **fields):
    return (i, *[fields.get(c) for c in RQ.REQUEST_FIELDS])


def test_parsed_like_single_requests(spark):
    """Every number and time text reads as ``parse_params`` reads it."""
    rows = [request(i, limit=n, offset=n, start_block=n, end_block=n) for i, n in enumerate(NUMBERS)]
    rows += [request(1000 + i, start_time=t, end_time=t) for i, t in enumerate(TIMES)]
    for r in RQ.parse(spark.createDataFrame(rows, SCHEMA)).collect():
        raw = dict(zip(("id", *RQ.REQUEST_FIELDS), next(x for x in rows if x[0] == r.request_id)))
        p = parse_params({k: v for k, v in raw.items() if k != "id" and v})
        assert (r.limit, r.offset, r.page_limit) == (p.limit, p.offset, effective_limit(p.limit)), raw
        assert (None if r.start_block is None else int(r.start_block)) == p.start_block, raw
        assert (None if r.end_block is None else int(r.end_block)) == p.end_block, raw
        when = None if p.start_time is None else p.start_time.astimezone(timezone.utc).replace(tzinfo=None)
        assert (None if r.start_time is None else r.start_time.astimezone(timezone.utc).replace(tzinfo=None)) == when, raw
        assert r.error == ("negative_offset" if p.offset < 0 else None)


@pytest.fixture(scope="module")
def transfers(spark):
    rng = random.Random(3)
    start = datetime(2023, 12, 25, tzinfo=timezone.utc)
    data = [(b, li, f"0x{rng.getrandbits(32):08x}{n}", rng.choice("aaaab"), rng.choice("xyz"), rng.choice("pq"), start + timedelta(hours=b // 1000))
            for n, (b, li) in enumerate((rng.choice([rng.randint(1, 400_000), 123_456]), rng.randint(0, 3)) for _ in range(1500))]
    return spark.createDataFrame(data, TRANSFERS).repartition(3).cache()


def test_answers_equal_single_requests(spark, transfers):
    rng = random.Random(11)
    pick = lambda *values: rng.choice(values)
    rows = [
        request(i, token=pick(None, None, "a", "b", "A", ""), to=pick(None, None, "p"), limit=pick(None, "3", "0", "1001", "x"), offset=pick(None, "0", "2", "40", "500", "-1"),
                start_block=pick(None, None, "100000", "123456", "18446744073709551615", "x"), end_block=pick(None, None, "123456", "300000", "18446744073709551615"),
                start_time=pick(None, None, "2024-01-01T00:00:00Z"), end_time=pick(None, None, "2024-01-03T00:00:00+05:00"), **{"from": pick(None, None, "x", "nobody")})
        for i in range(60)
    ]
    got = {}
    for r in RQ.answer(transfers, spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.request_id, []).append(r)
    all_rows = transfers.collect()
    for raw in rows:
        fields = dict(zip(RQ.REQUEST_FIELDS, raw[1:]))
        p = parse_params({k: v for k, v in fields.items() if v})
        answer = got.pop(raw[0])
        assert all((r.limit, r.offset) == (p.limit, p.offset) for r in answer)
        if p.offset < 0:
            assert [(r.error, r.total, r.position) for r in answer] == [("negative_offset", None, None)]
            continue
        hits = sorted((t for t in all_rows if matches(t, p)), key=lambda t: (-t.block_number, t.log_index, t.tx_hash))
        page = hits[p.offset : p.offset + effective_limit(p.limit)]
        assert {r.total for r in answer} == {len(hits)}, fields
        assert sorted((r.position, r.tx_hash) for r in answer if r.position is not None) == [(p.offset + k, t.tx_hash) for k, t in enumerate(page)], fields
        assert page or [r.position for r in answer] == [None]
    assert not got


def matches(t, p):
    return (
        (not p.token or t.token == p.token) and (not p.from_ or t["from"] == p.from_) and (not p.to or t.to == p.to)
        and (p.start_block is None or t.block_number >= p.start_block) and (p.end_block is None or t.block_number <= p.end_block)
        and (p.start_time is None or t.timestamp.astimezone(timezone.utc) >= p.start_time) and (p.end_time is None or t.timestamp.astimezone(timezone.utc) <= p.end_time)
    )


def test_single_request_agrees_with_the_listing(spark, transfers):
    one = spark.createDataFrame([request(1, token="a", limit="5", offset="3")], SCHEMA)
    p = parse_params({"token": "a", "limit": "5", "offset": "3"})
    page = [r.tx_hash for r in Q.page(transfers, p).collect()]
    answer = sorted(RQ.answer(transfers, one).collect(), key=lambda r: r.position)
    assert [r.tx_hash for r in answer] == page and answer[0].total == transfers.where(build_filter(p)).count()


def test_no_requests_and_no_transfers(spark, transfers):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([request(1), request(2, token="a"), request(3, offset="-1")], SCHEMA)
    assert RQ.answer(transfers, none).count() == 0
    got = sorted((r.request_id, r.total, r.position) for r in RQ.answer(transfers.limit(0), some).collect() if r.request_id < 3)
    assert got == [(1, 0, None), (2, 0, None)]
    assert RQ.answer(transfers, some.where("request_id = 3")).first().error == "negative_offset"


def test_joins_are_equi_joins(spark, transfers):
    some = RQ.parse(spark.createDataFrame([request(1), request(2, token="a"), request(3, token="a", to="p")], SCHEMA))
    for keys in ([], ["token"], ["token", "to"]):
        blocks = RQ._matching_blocks(transfers, some, keys).withColumn("asked", F.lit(0))
        pages = RQ._page_rows(transfers, RQ._needed_blocks(blocks), keys)
        for df in (blocks, pages):
            p = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
