import pytest
from pyspark.sql import functions as F

from tokenlake.operators import decode as D
from tokenlake.operators import dedup as DD
from tokenlake.schemas import BLOCK_SCHEMA, RAW_LOG_SCHEMA, TRANSFER_TOPIC

SIG = TRANSFER_TOPIC
A = "0x" + "00" * 12 + "11" * 20
B = "0x" + "00" * 12 + "22" * 20


def topic_of(addr_hex40: str, upper: str = "00" * 12) -> str:
    return "0x" + upper + addr_hex40


def data_of(v: int) -> str:
    return "0x" + format(v, "064x")


def log(topics, data, block=10, tx="0xAB", li=0, address="0xAbCdEf0000000000000000000000000000000001", txi=0):
    return (address, topics, data, block, tx, txi, li)


def blocks(spark, nums=(10, 11, 12)):
    return spark.createDataFrame([(n, 1_700_000_000 + n) for n in nums], BLOCK_SCHEMA)


def test_reject_reasons_in_guard_order(spark):
    t3 = [SIG, A, B]
    rows = [
        log([SIG, A], data_of(1), li=1),  # 2 topics
        log([SIG, A, B, A], data_of(1), li=2),  # 4 topics (ERC-721 style)
        log([], data_of(1), li=3),  # no topics
        log(None, data_of(1), li=4),
        log(["0x" + "ab" * 32, A, B], data_of(1), li=5),  # other event
        log(t3, "0x", li=6),  # 0 bytes
        log(t3, "0x" + "00" * 31, li=7),  # 31 bytes
        log(t3, "0x" + "00" * 33, li=8),  # 33 bytes
        log([SIG, A], "0x", li=9),  # topic count wins over length
        log([SIG.upper().replace("0X", "0x"), A, B], data_of(5), li=10),  # hash compares as bytes
        log(t3, data_of(5), li=11),
    ]
    df = spark.createDataFrame(rows, RAW_LOG_SCHEMA)
    got = {r.log_index: r.reject_reason for r in D.classify(df).collect()}
    assert got == {
        1: "topic_count", 2: "topic_count", 3: "topic_count", 4: "topic_count",
        5: "signature", 6: "data_length", 7: "data_length", 8: "data_length",
        9: "topic_count", 10: None, 11: None,
    }


def test_decode_fields(spark):
    upper = "ff" * 12  # non-zero upper 12 bytes: the address is the last 20 bytes
    rows = [log([SIG, topic_of("aa" * 20, upper), topic_of("BB" * 20)], data_of(10**18 + 5), tx="0xABCD", li=3)]
    t = D.transfers_from_raw(spark.createDataFrame(rows, RAW_LOG_SCHEMA), blocks(spark)).collect()[0]
    assert t["from"] == "0x" + "aa" * 20
    assert t["to"] == "0x" + "bb" * 20
    assert t.token == "0xabcdef0000000000000000000000000000000001"
    assert t.tx_hash == "0xabcd"
    assert t.value_string == str(10**18 + 5)
    assert t.value_decimal == pytest.approx(1.000000000000000005)
    assert t.event_signature == "Transfer"
    assert t.timestamp.timestamp() == 1_700_000_010
    assert t.block_bucket == 0


def test_missing_block_is_a_reject_or_an_error(spark):
    rows = [log([SIG, A, B], data_of(1), block=99, li=1), log([SIG, A, B], data_of(2), block=10, li=2)]
    df = spark.createDataFrame(rows, RAW_LOG_SCHEMA)
    transfers, rejects = D.decode_logs(df, blocks(spark))
    assert [r.log_index for r in transfers.collect()] == [2]
    assert [(r.log_index, r.reject_reason) for r in rejects.collect()] == [(1, "missing_block")]
    with pytest.raises(D.MissingHeaders):
        D.require_headers(df, blocks(spark))


def test_dedup_first_wins_and_keys(spark):
    t3 = [SIG, A, B]
    rows = [
        log(t3, data_of(7), block=11, tx="0x01", li=0),  # same key, later block
        log(t3, data_of(9), block=10, tx="0x01", li=0),  # first: earliest block
        log(t3, data_of(8), block=10, tx="0x01", li=1),  # same tx, other log index
        log(t3, data_of(3), block=10, tx="0x01", li=1),  # same key, same block: smaller value first
    ]
    t = D.transfers_from_raw(spark.createDataFrame(rows, RAW_LOG_SCHEMA), blocks(spark))
    got = {(r.tx_hash, r.log_index): (r.block_number, r.value_string) for r in DD.dedup_transfers(t).collect()}
    assert got == {("0x01", 0): (10, "9"), ("0x01", 1): (10, "3")}


def test_scan_range_inclusive_and_topic(spark):
    rows = [log([SIG, A, B], data_of(1), block=b, li=b) for b in (9, 10, 11, 12, 13)]
    rows.append(log(["0x" + "ab" * 32, A, B], data_of(1), block=11, li=99))
    s = D.scan_transfer_logs(spark.createDataFrame(rows, RAW_LOG_SCHEMA), 10, 12)
    assert sorted(r.log_index for r in s.collect()) == [10, 11, 12]


def test_rpc_json_reader(spark, scratch):
    from tokenlake.sources import rpc as RPC

    path = scratch("rpc")
    line = ('{"address":"0xAbCdEf0000000000000000000000000000000001","topics":["%s","%s","%s"],'
            '"data":"%s","blockNumber":"0x1a4","transactionHash":"0xFF","transactionIndex":"0x2",'
            '"logIndex":"0x10","removed":false}') % (SIG, A, B, data_of(42))
    spark.createDataFrame([(line,)], "value string").write.text(path + "/logs")
    spark.createDataFrame([('{"number":"0x1a4","timestamp":"0x5f5e100"}',)], "value string").write.text(path + "/h")
    logs = RPC.read_rpc_logs(spark, path + "/logs")
    r = logs.first()
    assert (r.block_number, r.tx_index, r.log_index) == (420, 2, 16)
    t = D.transfers_from_raw(logs, RPC.read_rpc_headers(spark, path + "/h")).first()
    assert t.value_string == "42" and t.timestamp.timestamp() == 100_000_000 and t.tx_hash == "0xff"


def test_duplicate_headers_do_not_duplicate_logs(spark):
    df = spark.createDataFrame([log([SIG, A, B], data_of(1), block=10)], RAW_LOG_SCHEMA)
    hdr = spark.createDataFrame([(10, 400), (10, 400), (11, 1)], BLOCK_SCHEMA)
    rows = D.attach_block_time(df, hdr).collect()
    assert len(rows) == 1 and rows[0].block_time == 400
    # headers that disagree give no time, like a missing one
    other = D.attach_block_time(df, hdr.unionByName(spark.createDataFrame([(10, 500)], BLOCK_SCHEMA))).collect()
    assert len(other) == 1 and other[0].block_time is None
