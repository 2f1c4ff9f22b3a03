import random
from collections import Counter

import numpy as np
from llm_rows import awkward, empty

from tokenlake.llm import probminhash as pm
from tokenlake.llm.common import read_table


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Smallest doc_id of everything linked by a Jaccard similarity of 0.8 or more, compared pair by pair."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in having[x] if j < i).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def classes(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.class_id for r in rows}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    wa[300:], wb[:60] = 0, 0
    both = (wa > 0) & (wb > 0)
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in np.flatnonzero(both))
    ia, ib = np.flatnonzero(wa), np.flatnonzero(wb)
    doc = np.repeat([0, 1], [len(ia), len(ib)])
    got = pm.prob_min_hash(doc, h[np.r_[ia, ib]], np.r_[wa[ia], wb[ib]], 2, registers=4096)
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_one_shingle_fills_all_registers():
    got = pm.prob_min_hash(np.array([0]), np.array([12345], np.uint64), np.ones(1), 1)
    assert (got == 12345).all()


def test_given_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert classes(pm.near_duplicates(docs)) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_group_of_near_copies_and_chains(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(60):  # near copies of one text: many pairs below the threshold, linked through others
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = word()
        rows.append((1000 - i, " ".join(w)))
    chain = [word() for _ in range(200)]
    for i in range(12):  # each a small step from the one before
        rows.append((i, " ".join(chain)))
        chain[(17 * i) % 200 : (17 * i) % 200 + 4] = [word() for _ in range(4)]
    rows += [(2000 + i, " ".join(word() for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert classes(pm.near_duplicates(docs)) == brute_classes(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert classes(pm.near_duplicates(docs)) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert pm.near_duplicates(empty(docs)).count() == 0
    kept = pm.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, None, 5, 7, -9]))
    assert pm.keep_one_of_each(empty(docs)).count() == 0


def test_repeated_lines_do_not_hide_near_copies(spark):
    """Pairs of Jaccard 0.8 or more, far apart in their weights, each alone in its buckets."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = []
    for i in range(60):
        base, footers = [word() for _ in range(210)], [[word() for _ in range(9)] for _ in range(2)]
        rows += [(2 * i + k, " ".join(base + f * 100)) for k, f in enumerate(footers)]
    want = brute_classes(rows)
    assert sum(want[2 * i + 1] == 2 * i for i in range(60)) == 60
    assert classes(pm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want
