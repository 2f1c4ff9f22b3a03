"""RPC call-log roll-ups (O2-O5): counters, duration histogram, failure streaks, heights.

The reference keeps these as in-process counters and a circuit breaker; here they
are aggregates over a call log (provider, method, ts, duration_s, ok, error,
height, seq).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FAILURE_THRESHOLD


def le_label(bound: float) -> str:
    return format(bound, "g")


def call_counters(call_log: DataFrame) -> DataFrame:
    """O2: requests and errors by (provider, method); partial aggregation map-side."""
    return call_log.groupBy("provider", "method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("ok")).alias("errors"),
    )


def call_errors(call_log: DataFrame) -> DataFrame:
    """O2: failed calls by (provider, error code)."""
    return call_log.where(~F.col("ok")).groupBy("provider", "error").agg(F.count(F.lit(1)).alias("errors"))


def duration_histogram(call_log: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """O3: cumulative ``le`` bucket counts per (provider, method), long form, '+Inf' last."""
    aggs = [F.count_if(F.col("duration_s") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = call_log.groupBy("provider", "method").agg(*aggs, F.count(F.lit(1)).alias("binf"))
    pairs = [f"'{le_label(b)}', b{i}" for i, b in enumerate(bounds)] + ["'+Inf', binf"]
    stacked = f"stack({len(pairs)}, {', '.join(pairs)}) AS (le, cumulative_count)"
    return wide.select("provider", "method", F.expr(stacked))


def duration_sum(call_log: DataFrame) -> DataFrame:
    """O3: histogram ``_sum`` (exact decimal sum, so independent of partitioning) and ``_count``."""
    return call_log.groupBy("provider", "method").agg(
        F.sum(F.col("duration_s").cast("decimal(20,6)")).cast("double").alias("duration_sum"),
        F.count(F.lit(1)).alias("duration_count"),
    )


def block_height(call_log: DataFrame) -> DataFrame:
    """Last seen height per provider (the latest call by (ts, seq))."""
    return call_log.groupBy("provider").agg(
        F.max_by("height", F.struct("ts", "seq")).alias("height")
    )


def _run_pieces(call_log: DataFrame, threshold: int, slice_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of consecutive failed calls per provider: inside a time slice, touching slice edges, and the slices.

    A window over ``provider`` alone would put a hot provider in one task. Runs
    are found inside (provider, time bucket of ``slice_seconds``) instead, so a busy hour
    of one provider is many tasks, and runs that touch a bucket edge are stitched in a
    second step over one summary row per bucket:

    1. inside a bucket, a failure's run id is the number of successes before it;
       runs not touching either edge are final;
    2. per bucket keep the prefix run (before the first success), the suffix run
       (after the last success) and whether the bucket failed entirely; with
       ``c`` = buckets before it that have a success, a prefix joins group c, a
       suffix starts group c + 1, an all-failed bucket joins group c; summing
       pieces by (provider, group) gives the spanning runs.
    """
    c = call_log.select(
        "provider",
        "ts",
        "seq",
        "ok",
        F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div {slice_seconds}").alias("bucket"),
    )
    okint = F.col("ok").cast("int")
    w_run = Window.partitionBy("provider", "bucket").orderBy("ts", "seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    w_all = Window.partitionBy("provider", "bucket")
    x = c.withColumns({"oks_before": F.sum(okint).over(w_run), "oks_total": F.sum(okint).over(w_all)})
    key = F.struct("ts", "seq")
    fail = ~F.col("ok")

    interior = (
        x.where(fail & (F.col("oks_before") > 0) & (F.col("oks_before") < F.col("oks_total")))
        .groupBy("provider", "bucket", "oks_before")
        .agg(F.min(key).alias("s"), F.max(key).alias("e"), F.count(F.lit(1)).alias("length"))
        .where(F.col("length") >= threshold)
        .select("provider", "s", "e", "length")
    )

    pre = fail & (F.col("oks_before") == 0)
    suf = fail & (F.col("oks_before") == F.col("oks_total")) & (F.col("oks_total") > 0)
    summary = x.groupBy("provider", "bucket").agg(
        (F.max("oks_total") > 0).alias("any_ok"),
        F.count_if(pre).alias("pre_n"),
        F.min(F.when(pre, key)).alias("pre_s"),
        F.max(F.when(pre, key)).alias("pre_e"),
        F.count_if(suf).alias("suf_n"),
        F.min(F.when(suf, key)).alias("suf_s"),
        F.max(F.when(suf, key)).alias("suf_e"),
    )
    w_prov = Window.partitionBy("provider").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn(
        "c", F.coalesce(F.sum(F.col("any_ok").cast("int")).over(w_prov), F.lit(0)).cast("bigint")
    )
    piece = lambda g, n, s, e: F.struct(g.alias("g"), F.col(n).alias("n"), F.col(s).alias("s"), F.col(e).alias("e"))
    pieces = summary.select(
        "provider",
        F.explode(
            F.array(
                piece(F.col("c"), "pre_n", "pre_s", "pre_e"),
                piece(
                    F.when(F.col("any_ok"), F.col("c") + 1).otherwise(F.lit(-1).cast("bigint")),
                    "suf_n",
                    "suf_s",
                    "suf_e",
                ),
            )
        ).alias("p"),
    ).where((F.col("p.n") > 0) & (F.col("p.g") >= 0))
    spanning = pieces.groupBy("provider", F.col("p.g").alias("g")).agg(F.min("p.s").alias("s"), F.max("p.e").alias("e"), F.sum("p.n").alias("length"))
    return interior, spanning, summary


def _runs(call_log: DataFrame, threshold: int, slice_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The runs of a part of the log (provider, s, e, length): those between two successes, and those at its edges.

    The first frame has the runs of length >= threshold with a success of the provider before and after them. The second
    one has a row per provider: ``any_ok``, and its runs before the first success (``pre``) and after the last one
    (``suf``) as structs (n, s, e), NULL if there is none; without any success ``pre`` is all of it.
    """
    interior, spanning, summary = _run_pieces(call_log, threshold, slice_seconds)
    oks = summary.groupBy("provider").agg(F.sum(F.col("any_ok").cast("int")).cast("bigint").alias("oks"))
    # group 0 lies before the first success, the last group after the last one
    placed = oks.join(spanning, "provider", "left")
    run = F.struct(F.col("length").alias("n"), "s", "e")
    edges = placed.groupBy("provider").agg(
        (F.max("oks") > 0).alias("any_ok"),
        F.first(F.when(F.col("g") == 0, run), ignorenulls=True).alias("pre"),
        F.first(F.when((F.col("g") == F.col("oks")) & (F.col("oks") > 0), run), ignorenulls=True).alias("suf"),
    )
    between = placed.where((F.col("g") > 0) & (F.col("g") < F.col("oks")) & (F.col("length") >= threshold)).select("provider", "s", "e", "length")
    return interior.unionByName(between), edges


def _shown(runs: DataFrame) -> DataFrame:
    return runs.select(
        "provider",
        F.col("s.ts").alias("start_ts"),
        F.col("s.seq").alias("start_seq"),
        F.col("e.ts").alias("end_ts"),
        F.col("e.seq").alias("end_seq"),
        F.col("length").cast("bigint").alias("length"),
    )


def failure_streaks(call_log: DataFrame, threshold: int = FAILURE_THRESHOLD, slice_seconds: int = 60) -> DataFrame:
    """Maximal runs of consecutive failed calls per provider, length >= threshold."""
    interior, spanning, _ = _run_pieces(call_log, threshold, slice_seconds)
    long = spanning.where(F.col("length") >= threshold).select("provider", "s", "e", "length")
    return _shown(interior.unionByName(long))


#: the run that a provider's log so far ends with, one row per provider whose last call failed
OPEN_RUN_SCHEMA = "provider string, n bigint, s struct<ts: timestamp_ntz, seq: bigint>, e struct<ts: timestamp_ntz, seq: bigint>"


def continue_streaks(call_log: DataFrame, open_runs: DataFrame, threshold: int = FAILURE_THRESHOLD,
                     slice_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """O4 over the next part of a log: (streaks that ended in it, the open runs after it).

    Runs form a monoid: a part of the log is its run before the first success, its run after the last one and
    whether it has a success at all. An open run is joined with what comes before the part's first success; if the part
    has none, it stays open. Nothing of earlier parts is read again.
    """
    closed, edges = _runs(call_log, threshold, slice_seconds)
    known = open_runs.select("provider", F.struct("n", "s", "e").alias("open"))
    both = edges.join(known, "provider", "full_outer")
    joined = F.when(
        F.col("open").isNotNull() | F.col("pre").isNotNull(),
        F.struct(
            (F.coalesce("open.n", F.lit(0)) + F.coalesce("pre.n", F.lit(0))).cast("bigint").alias("n"),
            F.coalesce("open.s", "pre.s").alias("s"),
            F.coalesce("pre.e", "open.e").alias("e"),
        ),
    )
    ends = F.coalesce("any_ok", F.lit(False))
    both = both.select("provider", ends.alias("ends"), joined.alias("first"), "suf")
    stitched = both.where(F.col("ends") & (F.col("first.n") >= threshold)).select("provider", "first.s", "first.e", F.col("first.n").alias("length"))
    still = both.select("provider", F.when(F.col("ends"), F.col("suf")).otherwise(F.col("first")).alias("r")).where("r IS NOT NULL")
    return _shown(closed.unionByName(stitched)), still.select("provider", "r.n", "r.s", "r.e")


def open_streaks(open_runs: DataFrame, threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """Streaks that have not ended yet."""
    return _shown(open_runs.where(F.col("n") >= threshold).withColumnRenamed("n", "length"))
