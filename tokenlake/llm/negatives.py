"""Hard-negative mining by slots of scores (operator 11).

Every anchor has a few positives, the best-scoring rows of its own label. A negative is hard for a positive if
its score lies in a window below the positive's: ``[low% , high%]`` of it. The windows of one anchor overlap,
so they are not searched one by one. Their upper limits cut the scores into disjoint slots; slot ``c`` holds the
scores that exactly ``c`` limits reach up to. Only the best ``k`` rows of every slot are kept, first within each
cell of rows, then over all cells. From the lowest slot up, the best of a slot and of all slots below it are
merged; this suffix is the answer for the limit that opens the slot, and the window's lower end cuts it off.

Scores are exact integers: components become ``floor(scale * x)``.

* Rows are dealt evenly into cells of about ``CELL_ROWS``; the anchors (a stated query set) go to every cell
  and stream through it, so a task holds one cell of packed vectors and the scores of ``ANCHORS_AT_ONCE`` anchors
  with ``BLOCK_ROWS`` rows, whatever the data's size. Nothing is collected or broadcast, and no label or key
  decides where a row goes.
* Each cell gives ``k`` rows per anchor and slot at most, so what is shuffled afterwards does not depend on
  how many rows share a label or a score.

Defined results: rows with a null label, a null vector or any null or non-finite component take no part; a
missing component of a shorter vector counts as 0; ties go to the smaller vec_id, null ids last; repeated rows
are rows of their own, also as positives of each other, and repeated anchors are anchors of their own; an
anchor without positives and a positive without hard negatives give no rows; an empty table gives none; other columns,
whatever their names, are ignored. A component of 2^31 or more after scaling, or a score of 2^56 or more in
size, raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import small_batches, written

SCALE = 256.0
CELL_ROWS = 1 << 18
BLOCK_ROWS = 1 << 14
ANCHORS_AT_ONCE = 256
_ROW = "uid long, vec_id long, label long, vector binary, is_anchor boolean"


# ---------------------------------------------------------------- vectors


def _packed(scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2048):
        lists = batch["vector"]
        flat = lists.flatten()
        x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
        ends = np.cumsum(lists.value_lengths().to_numpy()).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # a null component has become NaN
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        good = bad[ends] == bad[starts]
        whole = np.where(np.isfinite(x), x, 0.0)
        if np.abs(whole).max(initial=0.0) >= 2.0**31:
            raise OverflowError("a scaled component does not fit 32 bits")
        data = whole.astype(np.int32).tobytes()
        offsets = pa.py_buffer(np.concatenate([starts, ends[-1:]]).astype(np.int32) * 4)
        vectors = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(data)])
        rest = [batch[c] for c in ("uid", "vec_id", "label")]
        yield pa.RecordBatch.from_arrays([*rest, vectors, batch["is_anchor"]], ["uid", "vec_id", "label", "vector", "is_anchor"]).filter(pa.array(good))


def prepare(rows: DataFrame, label: Column, anchor: Column, scale: float = SCALE) -> DataFrame:
    """The rows that take part, their vectors packed as 32-bit integers; written once, ``uid`` names a row."""
    picked = rows.select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    picked = picked.where("label IS NOT NULL AND vector IS NOT NULL").withColumn("uid", F.monotonically_increasing_id())
    return written(picked.select("uid", "vec_id", "label", "vector", "is_anchor").mapInArrow(partial(_packed, scale), _ROW), "vectors")


def matrix(vectors: pa.Array) -> np.ndarray:
    """The packed vectors as rows, the shorter ones filled up with 0."""
    rows = [np.frombuffer(v, np.int32) for v in vectors.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as exact 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d].astype(np.float64), b[:, :d].astype(np.float64)
    bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(d, 1)
    if bound < 2.0**53:  # every partial sum is an integer that a double holds
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("a score may not fit 63 bits")


def best(found: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) positions of the ``k`` highest allowed scores of each anchor; of equal ones the first rows."""
    n = found.shape[1]
    if k < n:
        # the k-th highest score of each anchor; all that reach it are candidates, ties included
        least = np.partition(np.where(allowed, found, np.iinfo(np.int64).min), n - k, axis=1)[:, n - k]
        allowed = allowed & (found >= least[:, None])
    a, r = np.nonzero(allowed)
    kept = first_of_each((a,), (r, -found[a, r]), k)
    return a[kept], r[kept]


def first_of_each(groups: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the first ``k`` of every group; keys as for lexsort, the last one counts first."""
    by = np.lexsort((*order, *groups))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[by][1:] != g[by][:-1]
    at = np.arange(len(by))
    return by[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


# ---------------------------------------------------------------- cells

#: (scores, whether anchor and row differ, columns of the anchors, columns of the rows) -> (slot, anchors, rows), at most k of each slot
Pick = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _cell(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]:
    """ids, packed vectors and columns of a cell's rows; ties go to the smaller id, null last, so rows are in that order."""
    table = pa.Table.from_batches(parts)
    ids = table["vec_id"]
    table = table.take(pa.array(np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())))).combine_chunks()
    vectors = matrix(table["vector"].combine_chunks())
    return table["vec_id"].combine_chunks(), vectors, {c: table[c].to_numpy() for c in ("uid", "label")}


def _cell_best(pick: Pick, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every cell its rows come first, then the anchors; ``pick`` says which rows an anchor keeps."""
    number, parts, held = None, [], None
    for batch in batches:
        mark = batch["cell"].to_numpy() * 2 + batch["is_query"].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            part, (cell, is_query) = batch.slice(lo, hi - lo), divmod(int(mark[lo]), 2)
            if cell != number:
                number, parts, held = cell, [], None
            if not is_query:
                parts.append(part)
            elif parts or held:
                held = held or _cell(parts)
                parts = []
                for at in range(0, part.num_rows, ANCHORS_AT_ONCE):
                    yield from _asked(pick, k, part.slice(at, ANCHORS_AT_ONCE), *held)


def _asked(pick: Pick, k: int, some: pa.RecordBatch, ids: pa.Array, vectors: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of the cell for each of some anchors and each slot."""
    anchors = {"uid": some["uid"].to_numpy(), "label": some["label"].to_numpy()}
    if some["limits"].null_count < len(some):
        anchors |= {"limits": np.array(some["limits"].to_pylist(), np.int64), "least": some["least"].to_numpy()}
    queries, found = matrix(some["vector"]), []
    for lo in range(0, len(vectors), BLOCK_ROWS):
        block = {c: x[lo : lo + BLOCK_ROWS] for c, x in columns.items()}
        score = scores(queries, vectors[lo : lo + BLOCK_ROWS])
        other = anchors["uid"][:, None] != block["uid"][None, :]
        found += [(a, np.full(len(a), slot), score[a, r], r + lo) for slot, a, r in pick(score, other, anchors, block)]
    if found:
        a, slot, score, r = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = first_of_each((slot, a), (r, -score), k)
        out = [pa.array(anchors["uid"][a[kept]]), pa.array(slot[kept].astype(np.int32)), pa.array(score[kept]), ids.take(pa.array(r[kept]))]
        yield pa.RecordBatch.from_arrays(out, ["uid", "slot", "score", "vec_id"])


def _pick_positives(k: int, found, other, anchors, rows):
    same = anchors["label"][:, None] == rows["label"][None, :]
    yield 0, *best(found, same & other, k)


def _pick_slots(k: int, found, other, anchors, rows):
    """The best ``k`` of every slot: scores that exactly ``slot`` of the limits reach up to, none below ``least``."""
    limits = anchors["limits"]  # descending, the last one repeated
    wanted = (anchors["label"][:, None] != rows["label"][None, :]) & (found <= limits[:, :1]) & (found >= anchors["least"][:, None])
    reached = np.zeros(found.shape, np.int8)
    for j in range(limits.shape[1]):
        reached += found <= limits[:, j : j + 1]
    for slot in range(1, limits.shape[1] + 1):
        here = wanted & (reached == slot)
        busy = np.flatnonzero(here.any(axis=1))
        if len(busy):
            a, r = best(found[busy], here[busy], k)
            yield slot, busy[a], r


def _through_cells(rows: DataFrame, anchors: DataFrame, pick: Pick, k: int, cells: int) -> DataFrame:
    """(uid, slot, score, vec_id): the best ``k`` rows of every anchor and slot, over all cells."""
    dealt = rows.select(
        F.pmod(F.xxhash64("uid"), F.lit(cells)).alias("cell"), F.lit(False).alias("is_query"), "uid", "vec_id", "label", "vector",
        F.lit(None).cast("array<long>").alias("limits"), F.lit(None).cast("long").alias("least"),
    )
    queries = anchors.select(
        F.explode(F.expr(f"sequence(0L, {cells - 1}L)")).alias("cell"), F.lit(True).alias("is_query"), "uid", "vec_id", "label", "vector", "limits", "least"
    )
    together = dealt.unionByName(queries).repartition(cells, "cell").sortWithinPartitions("cell", "is_query")
    kept = together.mapInArrow(partial(_cell_best, pick, k), "uid long, slot int, score long, vec_id long")
    order = Window.partitionBy("uid", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# ---------------------------------------------------------------- mining


def _floor_percent(percent: int, score: Column) -> Column:
    x = F.lit(percent).cast("long") * score
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ceil_percent(percent: int, score: Column) -> Column:
    return -_floor_percent(percent, -score)


def mine(rows: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = SCALE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id and embedding; ``label`` and ``anchor`` (boolean) are columns over it. A negative of another
    label is hard for a positive if low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    ready = prepare(rows, label, anchor, scale)
    spark = rows.sparkSession
    cells = max(2 * spark.sparkContext.defaultParallelism, -(-ready.count() // cell_rows))
    anchors = ready.where("is_anchor")
    plain = anchors.withColumns({"limits": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("long")})
    first = written(_through_cells(ready, plain, partial(_pick_positives, positives), positives, cells), "positives")

    # per anchor: its positives in order, the limits of their windows (filled up to one length) and the lowest end
    one = F.struct("place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    lists = first.groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("positives"))  # at most ``positives`` each
    least = F.transform("positives", lambda p: _ceil_percent(low, p["positive_score"]))
    upper = F.transform("positives", lambda p: _floor_percent(high, p["positive_score"]))
    windows = lists.select("uid", "positives", least.alias("ends"), F.reverse(F.array_sort(upper)).alias("limits"))
    filled = F.concat("limits", F.array_repeat(F.element_at("limits", -1), F.lit(positives) - F.size("limits")))
    asked = anchors.join(windows.select("uid", filled.alias("limits"), F.array_min("ends").alias("least")), "uid")
    slots = _through_cells(ready, asked, partial(_pick_slots, negatives), negatives, cells)

    # from the lowest slot up: the best of the slot and of all slots below it
    hit = F.struct((-F.col("score")).alias("minus"), F.col("vec_id").isNull().alias("unnamed"), F.col("vec_id").alias("negative_id"))
    of_slot = slots.groupBy("uid", "slot").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # at most ``negatives`` each
    of_anchor = of_slot.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "hits"))).alias("by_slot"))
    merged = of_anchor.join(windows, "uid").join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    empty = F.expr("filter(map_values(by_slot)[0], h -> false)")
    suffixes = F.aggregate(
        F.sequence(F.lit(positives), F.lit(1), F.lit(-1)),
        F.array(empty),
        lambda done, slot: F.concat(F.array(F.slice(F.concat(F.coalesce(F.try_element_at("by_slot", slot), empty), done[0]), 1, negatives)), done),
    )
    # suffix c answers a window whose limit is reached from slot c on: the last place that the limit has among all limits
    pair = F.explode(F.arrays_zip("positives", "ends")).alias("pair")
    asked = merged.withColumn("suffixes", suffixes).select("anchor_id", "limits", "suffixes", pair)
    answers = asked.withColumn("limit", _floor_percent(high, F.col("pair.positives.positive_score"))).withColumn("slot", F.expr("size(filter(limits, l -> l >= limit))"))
    own = F.expr("filter(suffixes[slot - 1], h -> -h.minus >= pair.ends)")
    return answers.select("anchor_id", "pair", F.posexplode(own).alias("rank", "hit")).select(
        "anchor_id", F.col("pair.positives.positive_id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("hit.negative_id").alias("negative_id"),
        F.col("pair.positives.positive_score").alias("positive_score"), (-F.col("hit.minus")).alias("negative_score"),
    )
