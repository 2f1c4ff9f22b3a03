"""Listing (F*, T*) and aggregate (A*) queries over stored transfers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uint256 as U
from ..functions.params import TransferQueryParams, bucket_filter, build_filter, clamp

# Listing order: newest block first, then log index; tx_hash makes it total.
def listing_order() -> list[Column]:
    return [F.col("block_number").desc(), F.col("log_index").asc(), F.col("tx_hash").asc()]


def filtered(transfers: DataFrame, params: TransferQueryParams, normalize: bool = False) -> DataFrame:
    """Rows matching the parameters; block bounds also prune ``block_bucket``."""
    cond = build_filter(params, normalize=normalize)
    if "block_bucket" in transfers.columns:
        b = bucket_filter(params)
        if b is not None:
            cond = b & cond
    return transfers.where(cond)


def page(transfers: DataFrame, params: TransferQueryParams, normalize: bool = False) -> DataFrame:
    """One page, sorted; planned as a single TakeOrderedAndProject (top limit+offset per task)."""
    p = clamp(params)
    f = filtered(transfers, p, normalize)
    return f.orderBy(*listing_order()).offset(p.offset).limit(p.limit)


def page_after(transfers: DataFrame, params: TransferQueryParams, after: tuple[int, int, str]) -> DataFrame:
    """Keyset paging: the page after key (block_number, log_index, tx_hash); no O(offset) scan."""
    b, li, tx = after
    p = clamp(params)
    after_cond = (F.col("block_number") < b) | (
        (F.col("block_number") == b)
        & ((F.col("log_index") > li) | ((F.col("log_index") == li) & (F.col("tx_hash") > tx)))
    )
    return filtered(transfers, p).where(after_cond).orderBy(*listing_order()).limit(p.limit)


def page_total(transfers: DataFrame, params: TransferQueryParams) -> DataFrame:
    """Matching rows before paging, one row ``total``."""
    return filtered(transfers, params).agg(F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class Listing:
    """T5: the listing response; ``limit`` is echoed as requested, like the reference."""

    data: DataFrame
    total: int
    limit: int
    offset: int


def list_transfers(transfers: DataFrame, params: TransferQueryParams) -> Listing:
    total = page_total(transfers, params).first()["total"]
    return Listing(page(transfers, params), int(total), params.limit, params.offset)


def coerced_parts(value_parts: Column, dec128_ok: Column, value_string: Column) -> Column:
    """What the reference sums per row.

    Stored Decimal128 values count as stored (0 for values that did not parse);
    legacy rows (no ``dec128_ok``) count from their decimal text.
    """
    legacy = U.parts_from_decimal_text(value_string)
    # one CASE per chunk, so the optimizer reduces each sum's input to a field read
    return F.struct(
        *[
            F.when(dec128_ok.isNull(), legacy.getField(c))
            .when(dec128_ok, value_parts.getField(c))
            .otherwise(F.lit(0).cast("bigint"))
            .alias(c)
            for c in U.CHUNK_NAMES
        ]
    )


def aggregates(
    transfers: DataFrame,
    params: TransferQueryParams | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row: total_transfers, total_value (exact text), total_value_decimal,
    unique_tokens, unique_addresses, time_range{start, end}.

    Two aggregates over the same filtered input, combined by a union and a final
    one-row aggregate (no join): the address union needs an explode, which must
    not multiply the rows of the sums. Both are partial + final hash aggregates;
    the distinct counts are pre-aggregated per map task, so a hot token or
    address does not land whole in one reducer.
    """
    params = params or TransferQueryParams()
    f = filtered(transfers, params)
    parts = coerced_parts(F.col("value_parts"), F.col("dec128_ok"), F.col("value_string"))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    main = f.agg(
        F.count(F.lit(1)).alias("total_transfers"),
        distinct("token").alias("unique_tokens"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        *U.sum_parts_exprs(parts),
    )
    main = U.carried_sum_string(main, out="total_exact")
    addrs = f.select(F.explode(F.array(F.col("from"), F.col("to"))).alias("address"))
    addr_count = addrs.agg(distinct("address").alias("unique_addresses"))
    both = main.unionByName(addr_count, allowMissingColumns=True)
    one = both.agg(
        F.max("total_transfers").alias("total_transfers"),
        F.max("total_exact").alias("total_exact"),
        F.max("unique_tokens").alias("unique_tokens"),
        F.max("unique_addresses").alias("unique_addresses"),
        F.max("start").alias("start"),
        F.max("end").alias("end"),
    )
    total_value = F.when(F.col("total_transfers") == 0, F.lit("")).otherwise(F.col("total_exact"))
    return one.select(
        F.col("total_transfers").cast("bigint").alias("total_transfers"),
        total_value.alias("total_value"),
        F.coalesce(U.scaled_double(F.col("total_exact")), F.lit(0.0)).alias("total_value_decimal"),
        F.col("unique_tokens").cast("bigint").alias("unique_tokens"),
        F.col("unique_addresses").cast("bigint").alias("unique_addresses"),
        F.struct(F.col("start").alias("start"), F.col("end").alias("end")).alias("time_range"),
    )


def exact_total(transfers: DataFrame, params: TransferQueryParams | None = None) -> DataFrame:
    """The true uint256 sum of every matching row (no Decimal128 loss), as text."""
    f = filtered(transfers, params or TransferQueryParams())
    out = f.agg(F.count(F.lit(1)).alias("total_transfers"), *U.sum_parts_exprs(F.col("value_parts")))
    out = U.carried_sum_string(out, out="exact_total")
    return out.select("total_transfers", F.coalesce("exact_total", F.lit("0")).alias("exact_total"))
