"""Raw event logs, block headers and RPC call logs derived from the given tables.

The reference reads ``eth_getLogs`` results and block headers from a node. Here
the same shapes are derived, with Spark, from ``lineitem``/``orders``/``events``
so that every query's work grows with the tables (rules in FIXTURES.md 2):

* one raw log per lineitem row, joined to its order (sort-merge join on the
  order key at scale; both sides are large);
* block = 1 + days of the order date since 1995-01-01, or since the first order if that is earlier, so
  that blocks start at 1 whatever the table holds; block time = that UTC midnight;
* malformed logs on purpose: a 4th topic, a foreign topic 0, 31-byte data,
  and the largest uint256.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TRANSFER_TOPIC
from .tables import read_table

# Fixed values of the fixture rules.
GENESIS_DATE = date(1995, 1, 1)
FOREIGN_TOPIC = "0x" + "ab" * 32
N_PROVIDERS = 4
N_METHODS = 3
TIMEOUT_S = 30
MAX_UINT64 = str(2**64 - 1)
REQUEST_LIMITS = (None, "0", "-1", "5", "50", "1001", "x", "+7", "")
REQUEST_OFFSETS = (None, "0", "7", "abc", "300", "25", "-3", "1000000", "+12", "")


def _padded(digits: Column, width: int) -> Column:
    """The hex digits of a BIGINT, 16 at most, behind zeros; ``lpad`` copies its zeros one by one, so most of them are a literal."""
    return F.concat(F.lit("0" * (width - 16)), F.lpad(digits, 16, "0")) if width > 16 else F.lpad(digits, width, "0")


def _hex(c: Column, width: int) -> Column:
    return _padded(F.lower(F.hex(c)), width)


def genesis_of(orders: DataFrame) -> date:
    """The day of block 1: GENESIS_DATE, or the first order's day if that is earlier."""
    first = orders.agg(F.min(F.to_date("o_orderdate")).alias("d")).first().d
    return min(GENESIS_DATE, first) if first else GENESIS_DATE


def block_number_of(order_date: Column, genesis: date) -> Column:
    return (F.datediff(F.to_date(order_date), F.lit(genesis)) + 1).cast("bigint")


def chain_order() -> list[Column]:
    """The order of ``log_rows`` on the chain: block, transaction, log."""
    return [F.col("block_number"), _tx_index(), _log_index(), F.col("l_orderkey")]


def _tx_index() -> Column:
    return (F.col("l_orderkey") % 256).cast("int")


def _log_index() -> Column:
    return F.col("l_linenumber").cast("int")


def log_rows(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """What raw logs are made of, as numbers and flags: a fifth of the logs' width, so this is what is shuffled and sorted.

    What follows from another column (indexes, texts) is left to ``logs_of``.
    """
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate",
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("foreign"),
        (F.col("l_tax") == 0.08).alias("short"),
    )
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    genesis = genesis_of(orders)
    # hash-partition both sides on the order key: the join reuses this
    # partitioning (one exchange per side, as a sort-merge join needs anyway),
    # and the decode downstream runs in as many tasks as there are partitions
    li = li.repartition("l_orderkey")
    o = o.repartition("o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")

    # the join is hash-partitioned on the order key, so this window adds no shuffle
    delivery = Window.partitionBy("l_orderkey").orderBy(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return j.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "foreign", "short",
        (F.col("l_quantity") == 50).alias("wide"),
        # round half up (prices are positive); cheaper than round(), which goes through BigDecimal
        (F.col("l_extendedprice") * 100 + 0.5).cast("bigint").alias("cents"),
        block_number_of(F.col("o_orderdate"), genesis).alias("block_number"),
        # delivery position of the log within its transaction, as the source delivered
        # it (FIXTURES.md 2); first-wins dedup honours it where a source provides one
        F.row_number().over(delivery).cast("int").alias("arrival"),
    )


def logs_of(rows: DataFrame) -> DataFrame:
    """The raw logs of ``log_rows``, row by row."""
    pk = F.col("l_partkey")
    digits = F.hex(pk)  # Spark's hex is upper case
    address = F.concat(F.lit("0x"), _padded(F.when(pk % 2 == 0, digits).otherwise(F.lower(digits)), 40))

    t0 = F.when(F.col("foreign"), F.lit(FOREIGN_TOPIC)).otherwise(F.lit(TRANSFER_TOPIC))
    t1 = F.concat(F.lit("0x"), _hex(F.col("l_suppkey") * 31, 64))
    t2 = F.concat(F.lit("0x"), _hex(F.col("o_custkey"), 64))
    t3 = F.concat(F.lit("0x"), _hex(F.col("l_linenumber").cast("bigint"), 64))
    topics = F.when(F.col("l_linenumber") == 7, F.array(t0, t1, t2, t3)).otherwise(F.array(t0, t1, t2))

    body = F.concat(_hex(F.col("cents"), 50), _hex(pk, 14))
    body = F.when(F.col("wide"), F.lit("f" * 64)).otherwise(body)
    body = F.when(F.col("short"), F.substring(body, 3, 62)).otherwise(body)

    return rows.select(
        address.alias("address"),
        topics.alias("topics"),
        F.concat(F.lit("0x"), body).alias("data"),
        "block_number",
        F.concat(F.lit("0x"), _hex(F.col("l_orderkey"), 64)).alias("tx_hash"),
        _tx_index().alias("tx_index"),
        _log_index().alias("log_index"),
        "arrival",
    )


def raw_logs_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return logs_of(log_rows(lineitem, orders))


def blocks_from(orders: DataFrame) -> DataFrame:
    """One header per distinct block (partial aggregation before the shuffle)."""
    genesis = genesis_of(orders)
    b = orders.where("o_orderdate IS NOT NULL").select(block_number_of(F.col("o_orderdate"), genesis).alias("block_number")).distinct()
    days = F.lit((genesis - date(1970, 1, 1)).days)
    return b.select("block_number", ((days + F.col("block_number") - 1) * 86400).cast("bigint").alias("block_time"))


def call_log_from(events: DataFrame) -> DataFrame:
    """RPC call log: provider p0..p3 by user, method m0..m2 by event, failure = event type 'error', its code by value."""
    ok = F.col("event_type") != "error"
    return events.select(
        F.concat(F.lit("p"), (F.col("user_id") % N_PROVIDERS).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("event_id") % N_METHODS).cast("string")).alias("method"),
        F.col("ts"),
        F.col("value").alias("duration_s"),
        ok.alias("ok"),
        F.when(~ok, F.when(F.col("value") > TIMEOUT_S, "timeout").otherwise("server")).alias("error"),
        F.col("event_id").alias("height"),
        F.col("event_id").alias("seq"),
    )


def requests_from(events: DataFrame) -> DataFrame:
    """Listing requests as strings, one for each (user, event type), from its last event; some do not parse (FIXTURES.md 2)."""
    e, u = F.col("request_id"), F.col("user_id")
    last = events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("request_id"))
    address = lambda c: F.concat(F.lit("0x"), _hex(c, 40))
    one_of = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (e % by + 1).cast("int"))
    text = lambda c: c.cast("string")
    return last.select(
        "request_id",
        F.when(e % 4 == 0, address(e % 200 + 1)).when(e % 40 == 1, "0x" + "A".rjust(40, "0")).when(e % 4 == 2, "").alias("token"),
        F.when(e % 5 == 1, address((u % 10 + 1) * 31)).alias("from"),
        F.when(e % 7 == 2, address(u + 1)).alias("to"),
        one_of(REQUEST_LIMITS, len(REQUEST_LIMITS)).alias("limit"),
        one_of(REQUEST_OFFSETS, len(REQUEST_OFFSETS)).alias("offset"),
        F.when(e % 13 == 0, MAX_UINT64).when(e % 11 == 0, "12x").when(e % 3 == 0, F.concat(F.lit("+"), text(e % 2400))).alias("start_block"),
        F.when(e % 17 == 0, MAX_UINT64 + "0").when(e % 19 == 0, MAX_UINT64).when(e % 2 == 0, text(e % 2400 + e % 400)).alias("end_block"),
        F.when(e % 6 == 1, "1995-06-01T02:30:00+02:30").when(e % 6 == 3, "1996-13-01T00:00:00Z").when(e % 6 == 5, "1996-01-01").alias("start_time"),
        F.when(e % 8 == 3, "1999-12-31T23:59:59.999Z").when(e % 8 == 5, "2000-01-01T00:00:00-23:59").alias("end_time"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs_from(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from(read_table(spark, sf_dir, "orders"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_log_from(read_table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(read_table(spark, sf_dir, "events"))
