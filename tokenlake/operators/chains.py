"""R6 as a function of the data: of the rows of one key, keep those that are at least a horizon past the last kept one.

The rule is sequential within a key, but no key is one group here:

1. points: the distinct times of a key, each with its first row;
2. ``next`` of a point is the first point of the key a horizon or more later. Time is cut into buckets of one
   horizon, so it lies in the next bucket or is the first point of a later one: a window per (key, bucket), then one over a
   row per bucket;
3. the kept points are those that ``next`` reaches from the first one. Jumps over 1, 2, 4, ... points come from joining
   the jumps with themselves; going back from the longest, each round adds a jump to every point marked so far.

A bucket holds one kept point at most, so there are as many rounds as bits in the number of buckets. What was
kept before (``marks``) takes part as points, so micro-batches in time order give what one batch gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

DAY_US = 24 * 3600 * 1_000_000


def _next_points(points: DataFrame, horizon_us: int) -> DataFrame:
    """(key, t, jump): ``jump`` is the first point of the key at ``t + horizon`` or later, NULL if there is none."""
    bucket = F.expr(f"(at - pmod(at, {horizon_us}L)) div {horizon_us}L")
    held = points.select("key", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("t"), F.lit(1).alias("kind"))
    probes = points.select("key", (F.col("t") + horizon_us).alias("at"), "t", F.lit(0).alias("kind"))
    both = held.unionByName(probes).withColumn("bucket", bucket)
    # latest first, and a point before the probe of its own time: the last point seen is the first one not before the probe
    back = Window.partitionBy("key", "bucket").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("jump", F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(back))
    probed = seen.where("kind = 0").select("key", "t", "bucket", "jump")
    # one row per bucket: its first point, and the first point of any later bucket
    firsts = both.groupBy("key", "bucket").agg(F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("first"))
    later = Window.partitionBy("key").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select("key", "bucket", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    return probed.join(carried, ["key", "bucket"]).select("key", "t", F.coalesce("jump", "beyond").alias("jump"))


def kept_points(points: DataFrame, horizon_us: int) -> DataFrame:
    """(key, t) of the points that the rule keeps, from the mark of a key on, or from its first point.

    ``points`` (key, t, is_mark) has distinct (key, t).
    """
    jumps = [written(_next_points(points, horizon_us).where("jump IS NOT NULL"), "chain-jumps")]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        onward = last.select("key", F.col("t").alias("jump"), F.col("jump").alias("onward"))
        jumps.append(written(last.join(onward, ["key", "jump"]).select("key", "t", F.col("onward").alias("jump")), "chain-jumps"))
    start = F.coalesce(F.max(F.when(F.col("is_mark"), F.col("t"))), F.min("t"))
    marked = points.groupBy("key").agg(start.alias("t"))
    for jump in reversed(jumps[:-1]):
        marked = written(marked, "chain-marked")
        marked = marked.unionByName(marked.join(jump, ["key", "t"]).select("key", F.col("jump").alias("t")))
    return marked


def keep_chain(rows: DataFrame, key: str, time: str, order: list[str], horizon_us: int = DAY_US, marks: DataFrame | None = None) -> DataFrame:
    """The rows that the rule keeps, all columns kept.

    Of rows with one time the first by ``order`` counts. Rows with a NULL key are one key; a NULL time is dropped, since it has no
    place. ``marks`` (key, t) are the last kept times of earlier rows, in microseconds; rows that come after the row that
    made a mark but lie before it in time are not kept.
    """
    if horizon_us <= 0:
        raise ValueError(f"the horizon must be positive, got {horizon_us}")
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    micros = F.unix_micros(time) if dict(rows.dtypes)[time] == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    timed = rows.select(named.alias("__key"), micros.alias("__t"), F.struct(*rows.columns).alias("__row")).where("__t IS NOT NULL")
    first = timed.groupBy("__key", "__t").agg(F.min_by("__row", F.struct(*[f"__row.{c}" for c in order])).alias("__row"))
    first = written(first, "chain-rows")
    points = first.select(F.col("__key").alias("key"), F.col("__t").alias("t"), F.lit(False).alias("is_mark"))
    if marks is not None:
        known = marks.join(points.select("key").distinct(), "key", "left_semi").select("key", "t", F.lit(True).alias("is_mark"))
        points = points.unionByName(known).groupBy("key", "t").agg(F.max("is_mark").alias("is_mark"))
    kept = kept_points(points, horizon_us)
    if marks is not None:
        kept = kept.join(marks.select("key", "t"), ["key", "t"], "left_anti")
    found = first.join(kept.select(F.col("key").alias("__key"), F.col("t").alias("__t")), ["__key", "__t"])
    return found.select("__key", "__t", "__row.*")


def next_marks(kept: DataFrame, marks: DataFrame | None, seen_upto: int, horizon_us: int) -> DataFrame:
    """The last kept time of each key, without those that can no longer drop a row from ``seen_upto`` on."""
    last = kept.select(F.col("__key").alias("key"), F.col("__t").alias("t"))
    last = last if marks is None else last.unionByName(marks.select("key", "t"))
    return last.groupBy("key").agg(F.max("t").alias("t")).where(F.col("t") + horizon_us > seen_upto)


MARKS_SCHEMA = "key string, t bigint"


def keep_chain_stream(
    spark: SparkSession,
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    key: str,
    time: str,
    order: list[str],
    horizon_us: int = DAY_US,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
):
    """The rule over a stream whose micro-batches come in time order; writes the kept rows to ``out_dir/batch=<n>``.

    Marks of a micro-batch lie beside its rows, so a replayed one starts from the same marks and writes the same
    files. The state holds one time for each key seen in the last horizon. The output does not depend on where
    micro-batches end.
    """

    def one_batch(batch: DataFrame, n: int) -> None:
        rows = written(prepare(batch), "chain-batch")
        marks = spark.read.schema(MARKS_SCHEMA).parquet(f"{checkpoint}/marks/batch={n - 1}") if n else None
        kept = written(keep_chain(rows, key, time, order, horizon_us, marks), "chain-kept")
        upto = kept.agg(F.max("__t")).first()[0] or 0
        kept.drop("__key", "__t").write.mode("overwrite").parquet(f"{out_dir}/batch={n}")
        next_marks(kept, marks, upto, horizon_us).write.mode("overwrite").parquet(f"{checkpoint}/marks/batch={n}")

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint + "/query").trigger(availableNow=True).start()
