"""D1 first-wins dedup, U1 address union, U2 distinct blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tx_hash", "log_index"]
# First wins: chain order, then the source's delivery order when it has one
# (``arrival``), then every stored column, so the winner is total and does not
# depend on partitioning.
FIRST_WINS_ORDER = ["block_number", "tx_index", "arrival", "token", "from", "to", "value_hex"]


def dedup_transfers(transfers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (tx_hash, log_index), the first in ``order``.

    ``row_number() == 1`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so every map task keeps one row per key: a hot key is cut down
    map-side and cannot pile up in one reducer.
    """
    order = [c for c in (order or FIRST_WINS_ORDER) if c in transfers.columns]
    w = Window.partitionBy(*KEY).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = transfers.withColumn("__rn", F.row_number().over(w))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def address_universe(transfers: DataFrame) -> DataFrame:
    """The union of sender and receiver sets (one column ``address``)."""
    senders = transfers.select(F.col("from").alias("address"))
    receivers = transfers.select(F.col("to").alias("address"))
    return senders.union(receivers).distinct()


def distinct_blocks(logs: DataFrame) -> DataFrame:
    """Distinct block numbers of a batch (headers to look up)."""
    return logs.select("block_number").distinct()
