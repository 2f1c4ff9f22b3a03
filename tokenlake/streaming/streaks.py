"""O4 as a stream: failure streaks over micro-batches of the call log, with the open runs carried between them.

A micro-batch writes the streaks that ended in it to ``out_dir/batch=<n>`` and the open runs to the checkpoint. Both are
made from the open runs of the micro-batch before, so a replayed one writes the same files. The
state is one row per provider. Micro-batches come in time order, as calls are logged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callstats as CS
from ..schemas import FAILURE_THRESHOLD
from ..session import written


def streaks_stream(spark: SparkSession, call_log: DataFrame, out_dir: str, checkpoint: str, threshold: int = FAILURE_THRESHOLD,
                   processing_time: str | None = None):
    """Starts the query over a streaming ``call_log``; without ``processing_time`` it ends with what is there now."""

    def one_batch(batch: DataFrame, n: int) -> None:
        log = written(batch.select("provider", "ts", "seq", "ok"), "streak-batch")
        ended, still = CS.continue_streaks(log, _open_runs(spark, checkpoint, n - 1), threshold)
        ended.write.mode("overwrite").parquet(f"{out_dir}/batch={n}")
        still.write.mode("overwrite").parquet(_state(checkpoint, n))

    writer = call_log.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()


def _state(checkpoint: str, n: int) -> str:
    return f"{checkpoint}/open/batch={n}"


def _open_runs(spark: SparkSession, checkpoint: str, n: int) -> DataFrame:
    return spark.createDataFrame([], CS.OPEN_RUN_SCHEMA) if n < 0 else spark.read.schema(CS.OPEN_RUN_SCHEMA).parquet(_state(checkpoint, n))


def streaks_so_far(spark: SparkSession, out_dir: str, checkpoint: str, last_batch: int, threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """Every streak up to micro-batch ``last_batch``: those that ended, and those still open."""
    ended = spark.read.parquet(out_dir).where(F.col("batch") <= last_batch).drop("batch")
    return ended.unionByName(CS.open_streaks(_open_runs(spark, checkpoint, last_batch), threshold))
