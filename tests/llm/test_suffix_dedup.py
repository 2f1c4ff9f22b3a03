import hashlib
import random

import numpy as np
import pytest
from llm_rows import awkward, empty

from tokenlake.llm import suffix_dedup as sd
from tokenlake.llm.common import read_table


def brute(rows):
    """Contract by definition: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("symbols", [1, 2, 5, 200])
def test_suffix_array(symbols):
    rng = np.random.default_rng(symbols)
    for n in [*range(30), 100, 700]:
        x = rng.integers(1, symbols + 1, n)
        assert sd.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_pieces_of_a_long_text_have_the_anchors_of_the_whole(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choices(["the", "of", "anon", "sthea", "é", "x" * 60], k=4000)).encode()
    doc, at, anchor = sd.Anchors().of([text])
    monkeypatch.setattr(sd, "PIECE", 1000)
    doc2, at2, anchor2 = sd.Anchors().of([text])
    assert at.tolist() == at2.tolist() and anchor.tobytes() == anchor2.tobytes() and doc.tolist() == doc2.tolist()


def made_up(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    line = " ".join(word() for _ in range(14))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(1, 60)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + line + t[len(t) // 2 :]
        if i % 4 == 0 and rows:
            o = rng.choice(rows)[1]
            a = rng.randint(0, len(o))
            t += o[a : a + rng.randint(30, 90)]
        rows.append((rng.randint(-50, 10**10) if i % 5 else i, t))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("hot,block", [(sd.HOT, sd.BLOCK_CONTEXTS), (1, 2)])
def test_equals_the_definition(spark, hot, block):
    rows = made_up(150, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(sd.remove_repeats(docs, hot, block)) == brute(rows)


def test_given_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert result(sd.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = awkward(spark)
    small = docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    assert result(sd.remove_repeats(small)) == brute([(r.doc_id, r.text) for r in small.collect()])
    long = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert long[5].n_removed == 0 and long[6].n_removed == long[6].n_bytes - 4
    assert sd.remove_repeats(empty(docs)).count() == 0


real = sd.written


def test_contexts_are_dealt_without_a_shuffle_of_their_own(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(sd, "written", lambda df, name, **options: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name, **options))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = "".join(chr(97 + (i * i) % 23) for i in range(70))
        rows = [(i, f"{i:03d}" + shared + f"{i:05d}") for i in range(40)]
        got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_contexts=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["repeats-matched"] and "SortMergeJoin" not in plans["repeats-matched"]
    assert {r.doc_id: r.n_removed >= 70 for r in got} == {i: i > 0 for i in range(40)}


def test_contexts_hold_the_strings_of_their_anchor_and_no_others():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "anon", "sthea", "é", "x" * 60, "ab" * 30], k=k)).encode() for k in (0, 1, 9, 12, 40, 300, 2000)]
    doc, at, found = sd.Anchors().of(texts)
    size = np.array([len(t) for t in texts])
    rows = np.arange(len(at))
    first, last = sd.own_strings(doc, at, found["gram"], size[doc], rows)
    hashes = {(d, p): g for d, p, g in zip(doc.tolist(), at.tolist(), found["gram"].tolist(), strict=True)}
    for d, p, a, b in zip(doc.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
        # a string belongs to the anchors with the least hash in it; all string's least hashes are anchors
        mine = [s for s in range(max(p - 32, 0), min(p, len(texts[d]) - 50) + 1) if hashes[d, p] == min(hashes[d, q] for q in range(s, s + 33) if (d, q) in hashes)]
        assert [a, b] == [mine[0], mine[-1]] and len(mine) == b - a + 1
    some = rows[::3]  # the anchors asked for are judged beside all
    assert [x.tolist() for x in sd.own_strings(doc, at, found["gram"], size[doc], some)] == [first[some].tolist(), last[some].tolist()]


def test_a_blocks_contexts_are_no_longer_than_needed(spark, monkeypatch):
    """A context used to hold all 33 strings around its gram, about twice as many as the gram is the anchor of."""
    kept = {}
    monkeypatch.setattr(sd, "written", lambda df, name, **options: kept.setdefault(name, real(df, name, **options)))
    rows = made_up(60, 4)
    sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = [len(r.context) for r in kept["repeats"].filter("kind = 2").select("context").collect()]
    assert min(sizes) >= 50 and sum(sizes) / len(sizes) < 75
    texts = dict(rows)
    assert all(bytes(r.context) in texts[r.doc_id].encode() for r in kept["repeats"].filter("kind = 2").select("doc_id", "context").collect())


def test_order_of_numbers_that_fit_with_their_places_and_of_others():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 10, 1 << 62):
        keys = rng.integers(0, top, 5000)
        assert sd.ordered(keys, top).tolist() == np.argsort(keys, kind="stable").tolist()
    assert sd.ordered(np.zeros(0, np.int64), 5).tolist() == [] and sd.ordered(np.array([3]), 5).tolist() == [0]
