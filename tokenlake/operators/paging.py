"""T3 at any offset: the page is found by counting ranges, so that nothing before it is sorted.

The listing order is (block desc, log index, tx hash). Rows are counted by block bucket; the running sum tells
the bucket that holds the offset; inside it rows are counted by block, then, while a range is still large, by
log index and by ever longer prefixes of the tx hash. Each count is one partial and final aggregate over narrow columns, and each
table of counts is bounded by its key (buckets, blocks of a bucket, log indexes of a block, 16^4 prefixes),
whatever the number of rows. What is left to sort is the range that holds the offset and the page behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.params import TransferQueryParams, clamp
from ..schemas import BLOCK_BUCKET_SIZE
from . import query as Q

#: rows of a range that are sorted as they are
RANGE_ROWS = 100_000
PREFIX_STEP = 4  # hex digits by which a tx hash prefix grows


def _levels(rows: DataFrame) -> Iterator[tuple[Column, bool]]:
    """(key, descending) of ever smaller ranges in listing order."""
    bucket = F.col("block_bucket") if "block_bucket" in rows.columns else F.expr(f"block_number div {BLOCK_BUCKET_SIZE}")
    yield bucket, True
    yield F.col("block_number"), True
    yield F.col("log_index"), False
    for width in range(2 + PREFIX_STEP, 67, PREFIX_STEP):
        yield F.substring("tx_hash", 1, width), False


def _range_of(rows: DataFrame, key: Column, descending: bool, skip: int, take: int) -> Row:
    """``start``: the range that holds row number ``skip``; ``end``: the one with the last of ``take`` rows from there."""
    counts = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    order = F.col("key").desc() if descending else F.col("key").asc()
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.agg(
        F.min(F.when(F.col("upto") > skip, F.struct("upto", "n", "key"))).alias("start"),
        F.min(F.when(F.col("upto") >= skip + take, F.struct("upto", "key"))).alias("end"),
    ).first()


def locate(rows: DataFrame, offset: int, limit: int, range_rows: int = RANGE_ROWS) -> tuple[Column, int] | None:
    """A filter that keeps the page and what shares a range with its ends, and the rows to skip in it; None past the end."""
    skip, here, past, within, ends_here = offset, F.lit(True), F.lit(False), F.lit(True), True
    for key, descending in _levels(rows):
        found = _range_of(rows.where(here), key, descending, skip, limit)
        if found.start is None:
            return None
        at = F.lit(found.start.key)
        skip -= found.start.upto - found.start.n
        # implied by here | past, said again so that it reaches the scan
        within = within & ((key <= at) if descending else F.lit(True))
        if ends_here and found.end is not None:
            within = within & ((key >= F.lit(found.end.key)) if descending else (key <= F.lit(found.end.key)))
        ends_here = ends_here and found.end is not None and found.end.key == found.start.key
        past = past | (here & ((key < at) if descending else (key > at)))
        here = here & (key == at)
        if found.start.n <= range_rows:
            break
    return (here | past) & within, skip


def page_deep(transfers: DataFrame, params: TransferQueryParams, normalize: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The page at any offset, equal to ``query.page``."""
    p = clamp(params)
    rows = Q.filtered(transfers, p, normalize)
    place = locate(rows, p.offset, p.limit, range_rows)
    if place is None:
        return rows.limit(0)
    kept, skip = place
    return rows.where(kept).orderBy(*Q.listing_order()).offset(skip).limit(p.limit)
