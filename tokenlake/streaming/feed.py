"""Publish the transfer feed as JSON lines through ``writeStream``.

The store's log entries (one tiny JSON file per committed batch) are the
stream source. Each micro-batch takes the batches committed since the last one
and writes their rows as gzipped JSON lines to ``out_dir/seq=<n>`` in one job; ``seq`` is the commit
order. A reader cannot split a gzipped file, so FILE_ROWS bounds it. The write overwrites only those folders
(dynamic partition overwrite), so a replayed micro-batch is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import ENTRY_SCHEMA, TransferStore, transfer_json
from ..schemas import POLL_INTERVAL

#: lines in a published file, at most
FILE_ROWS = 250_000


def publish_feed(spark: SparkSession, store: TransferStore, out_dir: str, checkpoint: str,
                 available_now: bool = True, processing_time: str = POLL_INTERVAL, entries_per_trigger: int = 100):
    """``entries_per_trigger`` bounds how many batches one micro-batch publishes; none is dropped."""

    def one_batch(entries: DataFrame, _batch_num: int) -> None:
        # at most entries_per_trigger numbers
        new = [r.seq for r in entries.where("status = 'ok' AND inserted > 0").select("seq").distinct().collect()]
        if not new:
            return
        rows = store.read_stored().where(F.col("seq").isin(new))
        found = {r.seq for r in rows.select("seq").distinct().collect()}
        if found != set(new):
            raise RuntimeError(f"committed rows are gone: seq {sorted(set(new) - found)}")
        out = rows.select(transfer_json().alias("value"), "seq")
        options = {"partitionOverwriteMode": "dynamic", "compression": "gzip", "maxRecordsPerFile": FILE_ROWS}
        out.write.mode("overwrite").options(**options).partitionBy("seq").text(out_dir)

    stream = (
        spark.readStream.schema(ENTRY_SCHEMA)
        .option("maxFilesPerTrigger", entries_per_trigger)
        .json(f"{store.root}/_log/*")
    )
    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def read_feed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The published JSON lines with the number of their batch (from the folder name)."""
    return spark.read.text(out_dir).select("seq", F.col("value").alias("json"))
