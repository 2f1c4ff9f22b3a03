"""O6/O1 from the streams themselves: a listener that writes every micro-batch's progress to a table.

One small JSON file per query and micro-batch, named by them, so a micro-batch that is reported twice is
one row. Idle triggers, which run no micro-batch, are not written.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.store import Files

PROGRESS_SCHEMA = "query_id string, name string, batch bigint, ts string, input_rows bigint, duration_ms bigint, add_batch_ms bigint"


class ProgressLog(StreamingQueryListener):
    """Register with ``spark.streams.addListener(ProgressLog(spark, path))``; keeps nothing in the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path.rstrip("/"), Files(spark, path)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        durations = p.durationMs
        if "addBatch" not in durations:
            return
        row = {"query_id": str(p.id), "name": p.name, "batch": p.batchId, "ts": p.timestamp, "input_rows": p.numInputRows,
               "duration_ms": durations["triggerExecution"], "add_batch_ms": durations["addBatch"]}
        self.files.write_text(f"{self.path}/{p.id}-{p.batchId:012d}.json", json.dumps(row) + "\n")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def wait_for(log: ProgressLog, batches: int, seconds: float = 30.0) -> None:
    """Progress arrives on Spark's listener bus, a moment after the query has ended; raises if it does not."""
    until = time.monotonic() + seconds
    while len([n for n in log.files.names(log.path) if n.endswith(".json")]) < batches:
        if time.monotonic() > until:
            raise TimeoutError(f"fewer than {batches} micro-batches in {log.path}")
        time.sleep(0.1)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, name, batch, started_at, input_rows, duration_s): one row per micro-batch, in the shape that ``ingest.slow_batches``
    and ``callstats.duration_histogram`` take (provider and method name the query)."""
    raw = spark.read.schema(PROGRESS_SCHEMA).json(path)
    return raw.select(
        "query_id", "name", "batch", F.to_timestamp("ts").alias("started_at"), "input_rows", (F.col("duration_ms") / 1000).alias("duration_s"),
        F.coalesce("name", "query_id").alias("provider"), F.lit("micro_batch").alias("method"),
    )
