"""P17 and F1-F8 over a table of requests: many listings answered by a few joins.

``parse`` reads the request strings as columns, as leniently as ``params.parse_params``: what does not parse is
ignored. ``answer`` gives every request its total and its page.

Requests are grouped by which of token, from and to they name. For each of these groups (8 at most)

1. transfers of the named addresses are counted by (addresses, block, time); requests without an address
   count by block alone and take groups of blocks as a whole where their bounds hold the whole group;
2. each request takes the blocks inside its bounds: their sum is its total, and the running sum in
   listing order tells the blocks in which its page starts and ends;
3. the rows of those blocks are ranked once in each block, whatever number of requests wants them, and a request takes the
   slots of SLOT ranks that its page touches.

All joins are equi-joins (addresses, group, block or slot), so a request meets the rows of its own page only, give or take a slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_LIMIT, MAX_LIMIT
from ..session import scratch_path, written
from .query import listing_order

ADDRESSES = ("token", "from", "to")
#: columns of a request table beside its ``request_id``, all strings
REQUEST_FIELDS = (*ADDRESSES, "limit", "offset", "start_block", "end_block", "start_time", "end_time")
_RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:Z|([+-])(\d{2}):(\d{2}))$"
_NEGATIVE_OFFSET = "negative_offset"
#: blocks of a group, ranks of a slot, requests of a task
GROUP, SLOT, REQUESTS_PER_TASK = 64, 128, 10_000


def _signed(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def _unsigned(c: Column) -> Column:
    """Up to 2^64 - 1, as a DECIMAL that holds it."""
    v = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("decimal(38,0)"))
    return F.when(v <= F.lit(str(2**64 - 1)).cast("decimal(38,0)"), v)


def _instant(c: Column) -> Column:
    """RFC 3339 date-time as a timestamp; offsets up to 23:59 as the date-time they stand for."""
    part = lambda i: F.regexp_extract(c, _RFC3339, i)
    local = F.concat(part(1), F.lit("Z")).try_cast("timestamp")
    hours, minutes = F.coalesce(part(3).try_cast("int"), F.lit(0)), F.coalesce(part(4).try_cast("int"), F.lit(0))
    seconds = (hours * 60 + minutes) * F.when(part(2) == "-", -60).otherwise(60)
    shifted = F.timestamp_micros(F.unix_micros(local) - seconds.cast("bigint") * 1_000_000)
    return F.when(c.rlike(_RFC3339) & (hours < 24) & (minutes < 60), shifted)


def parse(requests: DataFrame) -> DataFrame:
    """Typed columns of every request; NULL is "not asked for".

    ``limit`` and ``offset`` are echoed as asked (defaults 100 and 0), ``page_limit`` is clamped; ``error`` names what makes a
    request invalid (a negative offset). An empty string counts as not given.
    """
    given = {c: F.nullif(F.col(c), F.lit("")) for c in REQUEST_FIELDS}
    limit = F.coalesce(_signed(given["limit"]), F.lit(DEFAULT_LIMIT).cast("bigint"))
    offset = F.coalesce(_signed(given["offset"]), F.lit(0).cast("bigint"))
    return requests.select(
        "request_id",
        *[given[c].alias(c) for c in ADDRESSES],
        *[_unsigned(given[c]).alias(c) for c in ("start_block", "end_block")],
        *[_instant(given[c]).alias(c) for c in ("start_time", "end_time")],
        limit.alias("limit"),
        F.when(limit <= 0, F.lit(DEFAULT_LIMIT)).otherwise(F.least(limit, F.lit(MAX_LIMIT))).cast("bigint").alias("page_limit"),
        offset.alias("offset"),
        F.when(offset < 0, F.lit(_NEGATIVE_OFFSET)).alias("error"),
    )


def _asked_for() -> Column:
    """One bit for each address that a request names."""
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(ADDRESSES)))


def _in_bounds(block: Column, time: Column) -> Column:
    at_least = lambda c, lo: lo.isNull() | (c >= lo)
    at_most = lambda c, hi: hi.isNull() | (c <= hi)
    return (
        at_least(block, F.col("start_block")) & at_most(block, F.col("end_block"))
        & at_least(time, F.col("start_time")) & at_most(time, F.col("end_time"))
    )


def _matching_blocks(transfers: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The requests' columns with (block_number, time, n, group): the blocks of every request, and the rows it has in them.

    Without addresses, groups of blocks that lie wholly inside a request's bounds come as one row each, with ``group`` and the
    last block and time of the group; what else lies inside comes by block (``group`` is NULL), as do blocks of addresses.
    """
    single = F.lit(None).cast("bigint").alias("group")
    rows = transfers.select(*keys, "block_number", F.col("timestamp").alias("time"))
    if keys:
        rows = rows.join(asked.select(*keys).distinct(), keys, "left_semi")
        blocks = rows.groupBy(*keys, "block_number", "time").agg(F.count("*").alias("n"))
        return asked.join(blocks, keys).where(_in_bounds(F.col("block_number"), F.col("time"))).select("*", single)
    blocks = _grouped_blocks(transfers)
    first, last = blocks.agg(F.min("group"), F.max("group")).first()
    if first is None:
        return asked.join(blocks.withColumn("request_id", F.lit(None).cast(dict(asked.dtypes)["request_id"])), "request_id").limit(0)
    size = F.lit(GROUP).cast("decimal(38,0)")
    # bounds reach beyond BIGINT: cut to the store's groups before the cast (least() skips a NULL bound)
    lo = F.greatest(F.lit(first), F.least(F.coalesce(F.floor(F.col("start_block") / size), F.lit(first)), F.lit(last + 1)).cast("bigint"))
    hi = F.least(F.floor(F.col("end_block") / size), F.lit(last)).cast("bigint")
    ranged = asked.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    touched = ranged.withColumn("group", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    groups = blocks.groupBy("group").agg(
        F.min("block_number").alias("lo_block"), F.max("block_number").alias("block_number"), F.min("time").alias("lo_time"), F.max("time").alias("time"), F.sum("n").alias("n"))
    inside = F.coalesce(_in_bounds(F.col("lo_block"), F.col("lo_time")) & _in_bounds(F.col("block_number"), F.col("time")), F.lit(False))
    met = touched.join(groups, "group").withColumn("inside", inside)
    cut = met.where(~F.col("inside")).select("group", *asked.columns).join(blocks, "group").where(_in_bounds(F.col("block_number"), F.col("time")))
    columns = [*asked.columns, "block_number", "time", "n"]
    return met.where("inside").select(*columns, "group").unionByName(cut.select(*columns, single))


def _grouped_blocks(transfers: DataFrame) -> DataFrame:
    """(block_number, time, n, group) of every block with transfers, written, so that its size is known to the joins."""
    blocks = transfers.groupBy("block_number", F.col("timestamp").alias("time")).agg(F.count("*").alias("n"))
    return written(blocks.withColumn("group", F.expr(f"block_number div {GROUP}")), "request-chain")


def answer(transfers: DataFrame, requests: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every request with its total and page: one row per listed transfer, or one row with NULL position if there is none.

    (request_id, error, total, limit, offset, position, then the transfer's columns); ``position`` counts from 0 in the whole
    result; ``columns`` names the transfer's columns that are wanted, by default all. A request with an error has no total. ``request_id`` is unique and not NULL; ``transfers`` has unique
    (block_number, log_index, tx_hash). Blocks and pages are written between the steps, so each step is a small plan.
    """
    spark = requests.sparkSession
    columns = columns or transfers.columns
    parsed = written(parse(requests).withColumn("asked", _asked_for()), "requests")
    valid = parsed.where("error IS NULL")
    counted = {r.asked: r["count"] for r in valid.groupBy("asked").count().collect()}  # 8 kinds at most
    kinds = sorted(counted)
    tasks = lambda kind: max(3 * spark.sparkContext.defaultParallelism, -(-counted[kind] // REQUESTS_PER_TASK))
    # a request grows to its blocks: dealt out by number, few requests too
    asked = {kind: valid.where(F.col("asked") == kind).repartition(tasks(kind), "request_id") for kind in kinds}
    keys = {kind: [c for i, c in enumerate(ADDRESSES) if kind >> i & 1] for kind in kinds}

    block_path, page_path = scratch_path(spark, "request-blocks"), scratch_path(spark, "request-pages")
    request = [f for f in parsed.schema if f.name in ("request_id", "asked", *ADDRESSES, "offset", "page_limit")]
    block = [T.StructField("block_number", T.LongType()), T.StructField("time", transfers.schema["timestamp"].dataType), T.StructField("n", T.LongType()), T.StructField("group", T.LongType())]
    block_schema = T.StructType(request + block)
    for kind in kinds:
        _matching_blocks(transfers, asked[kind], keys[kind]).select(*block_schema.fieldNames()).write.mode("append").parquet(block_path)
    blocks = _read(spark, block_schema, block_path, kinds)
    totals = blocks.groupBy("request_id").agg(F.sum("n").alias("total"))
    needed = written(_needed_blocks(blocks), "request-needed")
    if 0 in kinds:
        needed = written(needed.where("group IS NULL").unionByName(_split_groups(needed, _grouped_blocks(transfers)).select(*needed.columns)), "request-needed")

    page_schema = T.StructType([parsed.schema["request_id"], T.StructField("position", T.LongType()), *[transfers.schema[c] for c in columns]])
    for kind in kinds:
        page = _page_rows(transfers, needed.where(F.col("asked") == kind), keys[kind])
        page.select(*page_schema.fieldNames()).write.mode("append").parquet(page_path)
    pages = _read(spark, page_schema, page_path, kinds)
    total = F.when(F.col("error").isNull(), F.coalesce("total", F.lit(0).cast("bigint"))).alias("total")
    head = parsed.select("request_id", "error", "limit", "offset")
    joined = head.join(totals, "request_id", "left").join(pages, "request_id", "left")
    return joined.select("request_id", "error", total, "limit", "offset", "position", *columns)


def _read(spark: SparkSession, schema: T.StructType, path: str, parts: list) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if parts else spark.createDataFrame([], schema)


def _needed_blocks(blocks: DataFrame, start: Column | int = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """The blocks (or groups) that hold a part of a request's page, with the rows that its listing has ``before`` them and ``upto`` their end.

    ``times`` counts the request's rows for the block: headers give a block one time; several interleave in the listing, so the running sum goes by block.
    """
    newest = Window.partitionBy("request_id", *within).orderBy(F.col("block_number").desc(), F.col("time"))
    placed = blocks.withColumn("upto", start + F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    of_block = Window.partitionBy("request_id", *within, "block_number")
    placed = placed.withColumns({"upto": F.max("upto").over(of_block), "times": F.count("*").over(of_block), "of_block": F.sum("n").over(of_block)})
    placed = placed.withColumn("before", F.col("upto") - F.col("of_block")).drop("of_block", "n")
    return placed.where((F.col("upto") > F.col("offset")) & (F.col("before") < F.col("offset") + F.col("page_limit")))


def _split_groups(needed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The needed blocks of the needed groups."""
    groups = needed.where("group IS NOT NULL").withColumnRenamed("before", "start").drop("block_number", "time", "upto", "times")
    return _needed_blocks(groups.join(blocks, "group"), F.col("start"), ("group",)).drop("start")


def _page_rows(transfers: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """(request_id, position, the transfer's columns) of the pages.

    Rows are ranked in their block before they meet the requests, so a row's work does not grow with the requests that list its block.
    """
    place = [*keys, "block_number", "time"]
    start, end = F.greatest(F.col("offset") - F.col("before"), F.lit(0)), F.least(F.col("offset") + F.col("page_limit"), F.col("upto")) - F.col("before")
    wanted = needed.where("times = 1").select("request_id", *place, "before", start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    wanted = wanted.withColumn("slot", F.explode(F.sequence(F.expr(f"start div {SLOT}"), F.expr(f"(`end` - 1) div {SLOT}"))))
    rows = transfers.withColumn("time", F.col("timestamp")).join(needed.select(*place).distinct(), place, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(*listing_order()[1:])) - 1
    ranked = rows.withColumn("rank", rank.cast("bigint")).withColumn("slot", F.expr(f"rank div {SLOT}"))
    pages = ranked.join(wanted, [*place, "slot"]).where("rank >= start AND rank < `end`").withColumn("position", F.col("before") + F.col("rank"))
    pages = pages.select("request_id", "position", *transfers.columns)
    if needed.where("times > 1").isEmpty():
        return pages
    return pages.unionByName(_interleaved(transfers, needed.where("times > 1"), keys).select(*pages.columns))


def _interleaved(transfers: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """Pages in blocks of several times, of which a request takes more than one: its rows of the block are ranked for each request."""
    wanted = needed.select("request_id", *keys, "block_number", "time", "before", "offset", "page_limit")
    rows = transfers.withColumn("time", F.col("timestamp")).join(wanted, [*keys, "block_number", "time"])
    # a block's first row in the listing is number ``before``, so ranks stay inside (request, block): no request is one group
    rank = F.row_number().over(Window.partitionBy("request_id", "block_number").orderBy(*listing_order()[1:]))
    ranked = rows.withColumn("position", (F.col("before") + rank - 1).cast("bigint"))
    return ranked.where((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("page_limit")))
