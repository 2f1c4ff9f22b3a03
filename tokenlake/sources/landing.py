"""Landed inputs and the backfilled store, derived once per table snapshot.

The reference reads logs from a node and answers queries from its store. Here
the raw logs and headers derived from the given tables are *landed* as Parquet
(sorted by block, so a block-range scan prunes row groups), and the store is
built from them by the real ingest path (decode, dedup, insert-ignore). Both
live in the shared folder named by ``spark.checkpoint.dir``, keyed by the table
files' sizes and times and by LANDING_VERSION, and are written to a
temporary name and renamed, so a lost executor or a concurrent run never
leaves a half-written input behind.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import decode as D
from ..operators.store import Files, TransferStore
from ..schemas import BLOCK_SCHEMA, RAW_LOG_WITH_ARRIVAL_SCHEMA
from ..session import checkpoint_root, shuffles_removed
from . import fixtures as FX
from .tables import read_table

# Changes whenever landed data or the store are derived or laid out differently.
LANDING_VERSION = "8"
#: logs in a landed file, at most about; more logs make more files, so no task grows with the tables
ROWS_PER_FILE = 500_000
LANDED_LOG_SCHEMA = T.StructType(RAW_LOG_WITH_ARRIVAL_SCHEMA.fields + [T.StructField("topic0", T.StringType())])


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("lineitem", "orders", "events")) -> str:
    """Names a snapshot of the tables: path, size and time of every file, as the file system reports them.

    Tables may be single files or folders, on any Hadoop file system.
    """
    h = hashlib.sha1(LANDING_VERSION.encode())
    files = Files(spark, sf_dir)
    for t in tables:
        h.update(repr((t, files.statuses(f"{sf_dir}/{t}.parquet"))).encode())
    return h.hexdigest()[:16]


def table_bytes(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("lineitem", "orders", "events")) -> int:
    """Bytes of the tables' files, as the file system reports them."""
    files = Files(spark, sf_dir)
    return sum(size for t in tables for _, size, _ in files.statuses(f"{sf_dir}/{t}.parquet"))


def land_root(spark: SparkSession, sf_dir: str) -> str:
    return f"{checkpoint_root(spark)}/tokenlake/{fingerprint(spark, sf_dir)}"


def materialise(spark: SparkSession, final: str, write) -> None:
    """Runs ``write(path)`` once for ``final``: to a temporary name, renamed unless another run was first.

    Its jobs are a chain, so each one's shuffle files go before the next.
    """
    files = Files(spark, final)
    if files.exists(final):
        return
    tmp = f"{final}.tmp-{uuid.uuid4().hex[:8]}"
    with shuffles_removed(spark):
        write(tmp)
    files.move(tmp, final)  # False: the published copy is identical


def landed_raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs as landed files: range-partitioned and sorted by block (S1 prunes ranges)."""
    path = f"{land_root(spark, sf_dir)}/raw_logs"

    def write(p: str) -> None:
        lineitem = read_table(spark, sf_dir, "lineitem")
        # an explicit file count (AQE does not coalesce it): reads of the landed
        # logs split into at least this many tasks, whatever the row-group size
        n = max(2 * spark.sparkContext.defaultParallelism, -(-lineitem.count() // ROWS_PER_FILE))
        # numbers are dealt out and sorted (the range partitioner samples them from the join's shuffle files); texts are made in the writing tasks
        order = FX.chain_order()
        rows = FX.log_rows(lineitem, read_table(spark, sf_dir, "orders")).repartitionByRange(n, *order).sortWithinPartitions(*order)
        # topic0 as a plain column: an equality on it reaches the Parquet reader
        # (an array element does not), so the S1 topic filter is pushed down
        FX.logs_of(rows).withColumn("topic0", D.topic0(F.col("topics"))).write.option("compression", "zstd").parquet(p)

    materialise(spark, path, write)
    return spark.read.schema(LANDED_LOG_SCHEMA).parquet(path)


def landed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{land_root(spark, sf_dir)}/blocks"

    def write(p: str) -> None:
        FX.blocks(spark, sf_dir).repartitionByRange("block_number").sortWithinPartitions("block_number").write.parquet(p)

    materialise(spark, path, write)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def backfilled_store(spark: SparkSession, sf_dir: str) -> TransferStore:
    """The store after one backfill of every landed log (built once per snapshot)."""
    from ..streaming.ingest import backfill

    path = f"{land_root(spark, sf_dir)}/store"

    def write(p: str) -> None:
        store = TransferStore(spark, p)
        backfill(store, landed_raw_logs(spark, sf_dir), landed_blocks(spark, sf_dir), from_block=0)

    materialise(spark, path, write)
    return TransferStore(spark, path)
