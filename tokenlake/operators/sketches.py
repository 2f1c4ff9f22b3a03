"""A1-A6 from stored summaries: exact counts, sums and times, distinct counts from HyperLogLog sketches.

A summary is one row per block bucket: rows, exact chunk sums of the values, first and last time, and mergeable
sketches of tokens and of addresses (senders and receivers together). The store keeps summaries of its
older commits (``TransferStore.index_commits``). A request without address and time bounds takes whole buckets from
them; only the buckets that its block bounds cut, and commits too young for a summary, are read as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uint256 as U
from ..functions.params import TransferQueryParams, bucket_filter, build_filter
from ..schemas import BLOCK_BUCKET_SIZE
from . import query as Q

LG_K = 12
#: three standard errors of a merged sketch with 2^LG_K registers
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
_SUMS = [f"__sum_{c}" for c in U.CHUNK_NAMES]


def summarise(transfers: DataFrame) -> DataFrame:
    """One row per block bucket; partial aggregates before the shuffle."""
    parts = Q.coerced_parts(F.col("value_parts"), F.col("dec128_ok"), F.col("value_string"))
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(LG_K))
    grouped = transfers.groupBy("block_bucket").agg(
        F.count("*").alias("n"), sketch("token").alias("tokens"), sketch("from").alias("senders"), sketch("to").alias("receivers"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), *U.sum_parts_exprs(parts),
    )
    return grouped.select("block_bucket", "n", "tokens", F.hll_union("senders", "receivers").alias("addresses"), "start", "end",
                          *[F.col(c).cast("decimal(38,0)").alias(c) for c in _SUMS])


def merge(summaries: DataFrame) -> DataFrame:
    """The aggregate response (A1-A7) from summaries, in the shape of ``query.aggregates``."""
    count = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("bigint")
    one = summaries.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_transfers"), count("tokens").alias("unique_tokens"), count("addresses").alias("unique_addresses"),
        F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS],
    )
    one = U.carried_sum_string(one, out="total_exact")
    return one.select(
        "total_transfers", F.when(F.col("total_transfers") == 0, F.lit("")).otherwise(F.col("total_exact")).alias("total_value"),
        F.coalesce(U.scaled_double(F.col("total_exact")), F.lit(0.0)).alias("total_value_decimal"), "unique_tokens", "unique_addresses",
        F.struct("start", "end").alias("time_range"),
    )


def whole_buckets(params: TransferQueryParams) -> tuple[int | None, int | None]:
    """First and last block bucket that lie wholly inside the block bounds; None is no bound."""
    lo, hi = params.start_block, params.end_block
    return None if lo is None else -(-lo // BLOCK_BUCKET_SIZE), None if hi is None else (hi + 1) // BLOCK_BUCKET_SIZE - 1


def aggregates(store, params: TransferQueryParams | None = None) -> DataFrame:
    """The aggregate response for a request by blocks; distinct counts within ``ERROR`` of the exact ones (99.7 %)."""
    params = params or TransferQueryParams()
    if params.token or params.from_ or params.to or params.start_time or params.end_time:
        raise ValueError("summaries answer requests by block bounds only; use query.aggregates")
    lo, hi = whole_buckets(params)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col("block_bucket") >= F.lit(min(lo, 2**62)))
    if hi is not None:
        inside = inside & (F.col("block_bucket") <= F.lit(min(hi, 2**62)))
    old, upto = store.summaries()
    rows = store.read_stored()
    wanted = build_filter(params)
    if (pruned := bucket_filter(params)) is not None:
        wanted = pruned & wanted
    parts = [summarise(rows.where(wanted & (F.col("seq") > upto)))] if upto < store.last_seq() else []
    if old is not None:
        parts.append(old.where(inside))
        if lo is not None or hi is not None:  # the buckets that the bounds cut
            parts.append(summarise(rows.where(wanted & (F.col("seq") <= upto) & ~inside)))
    if not parts:
        parts = [summarise(rows.where(F.lit(False)))]
    return merge(reduce(DataFrame.unionByName, parts))
