from collections import defaultdict

import pytest
from llm_rows import awkward, empty

from tokenlake.llm import mixing


def reshared(sizes, weights, times=3):
    """Targets by resharing what full sources leave over until none is above."""
    target, total = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    full = set()
    while True:
        left = total - sum(times * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: times * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > times * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_equal_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0, "e": 55, None: 400}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    rows = rows.withColumn("skey", mixing.source_key(rows["source"]))
    got = {r.source: r.target for r in mixing.targets(mixing.cycled_weights(rows, (5, 2, 1))).collect()}
    want = reshared(sizes, weights)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_takes_the_targets_and_repeats_itself(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 4}") for i in range(300)] + [(300, "x " * 4000, "s0"), (301, None, "s1"), (302, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_words=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block_words=64).collect()))
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: int(t) for s, t in target.items()} == dict(taken)


def test_every_prefix_of_the_schedule_is_near_the_shares(spark):
    shares = spark.createDataFrame([("=a", "a", 9000, 6000.0), ("=b", "b", 9000, 3000.0), ("=c", "c", 9000, 1500.0)],
                                   "skey string, source string, source_size long, target double")
    slots = sorted((r.point, r.skey) for r in mixing.schedule(shares, block_words=10).collect())
    assert len(slots) == 1050
    seen = defaultdict(int)
    for n, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        for key, share in (("=a", 6 / 10.5), ("=b", 3 / 10.5), ("=c", 1.5 / 10.5)):
            assert abs(seen[key] - share * n) < 12


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(empty(docs)).count() == 0
