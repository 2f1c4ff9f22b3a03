import math
import random

import numpy as np
import pytest
from llm_rows import empty
from pyspark.sql import functions as F

from tokenlake.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """By the definition, row by row: (anchor, positive, rank, negative, scores)."""
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
          if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, va, la) in enumerate(ok):
        if a is None or a % 50:
            continue
        score = [sum(x * y for x, y in zip(va, vb, strict=False)) for _, vb, _ in ok]
        order = sorted(range(len(ok)), key=lambda j: (-score[j], ok[j][0] is None, ok[j][0] or 0))
        for p in [j for j in order if j != n and ok[j][2] == la][:positives]:
            fits = [j for j in order if ok[j][2] != la and low * score[p] <= 100 * score[j] <= high * score[p]]
            out += [(a, ok[p][0], k + 1, ok[j][0], score[p], score[j]) for k, j in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in N.mine(df, F.col("label"), F.col("vec_id") % 50 == 0, **options).collect()), key=str)


def vectors(rng, n, d, labels, grain):
    """Few different component values, so that scores tie often."""
    return [(i, [float(np.float32(rng.randint(-grain, 2 * grain) / grain)) for _ in range(d)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "labels", "grain"), [(400, 3, 3, 2), (600, 8, 10, 50), (300, 1, 2, 1)])
def test_equals_brute_force(spark, n, d, labels, grain):
    rows = vectors(random.Random(n), n, d, labels, grain)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("cell_rows", [7, 40])
def test_cells_and_blocks_do_not_matter(spark, cell_rows, monkeypatch):
    rows = vectors(random.Random(5), 500, 4, 4, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, positives=4, negatives=2, low=20, high=90)
    assert found(df, positives=4, negatives=2, low=20, high=90, cell_rows=cell_rows) == want


def test_blocks_of_a_cell_are_merged():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(0, False, i, i, i % 3, rng.integers(-4, 5, 6).astype(np.int32).tobytes(), None, None) for i in range(300)]
    rows += [(0, True, i, i, i % 3, rows[i][5], None, None) for i in range(0, 300, 40)]
    names = ["cell", "is_query", "uid", "vec_id", "label", "vector", "limits", "least"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(block, at_once):
        N.BLOCK_ROWS, N.ANCHORS_AT_ONCE = block, at_once
        out = N._cell_best(lambda *x: N._pick_positives(5, *x), 5, iter([batch.slice(0, 123), batch.slice(123)]))
        return sorted(tuple(r.values()) for b in out for r in b.to_pylist())

    try:
        assert run(1 << 14, 256) == run(17, 3)
    finally:
        N.BLOCK_ROWS, N.ANCHORS_AT_ONCE = 1 << 14, 256


def test_slots_are_disjoint_and_keep_the_best():
    rng = np.random.default_rng(1)
    score = rng.integers(0, 100, (6, 500))
    anchors = {"label": np.zeros(6, int), "limits": np.sort(rng.integers(20, 90, (6, 5)))[:, ::-1], "least": np.full(6, 5)}
    rows = {"label": rng.integers(0, 2, 500)}
    kept = {(slot, a): [] for slot in range(1, 6) for a in range(6)}
    for slot, a, r in N._pick_slots(3, score, None, anchors, rows):
        for i, j in zip(a.tolist(), r.tolist()):
            kept[slot, i].append(j)
    for (slot, i), rs in kept.items():
        fits = [j for j in range(500) if rows["label"][j] and score[i, j] >= 5 and (anchors["limits"][i] >= score[i, j]).sum() == slot]
        assert rs == sorted(fits, key=lambda j: (-score[i, j], j))[:3]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.75], 2), (2, [0.5, 0.75], 2), (3, [0.5, 0.75, 9.0], 2), (4, [0.9], 3),
        (5, [], 2), (6, None, 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, None], 2), (10, [0.5, 0.75], None), (None, [0.5, 0.75], 2),
        (None, [1.0, 1.0], 1), (50, [-1.0, 0.0], 4), (51, [0.5, 0.0], 4), (52, [-0.5, 0.0], 5), (100, [0.0, 0.0], 6), (101, [0.0, 0.0], 6), (150, [2.0, 2.0], 7),
        (-50, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for clash in ("uid", "cell", "slot", "score", "limits", "vector", "place", "is_anchor", "positives", "rank", "anchor_id"):
        df = df.withColumn(clash, F.lit("clash"))
    assert found(df) == brute(rows)
    assert found(empty(df)) == []


def test_one_label_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(i, v, 0 if rng.random() < 0.9 else label) for i, v, label in vectors(rng, 800, 4, 5, 2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_large_components():
    a, b = np.array([[2**30, -(2**30)]], np.int32), np.array([[3, 2**31 - 1]], np.int32)
    assert N.scores(a, b).tolist() == [[3 * 2**30 - 2**30 * (2**31 - 1)]]
    with pytest.raises(OverflowError):
        N.scores(np.full((1, 64), 2**31 - 1, np.int32), np.full((1, 64), 2**31 - 1, np.int32))
