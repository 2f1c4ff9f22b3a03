import math
import random
from collections import Counter

import numpy as np
from llm_rows import awkward, empty

from tokenlake.llm import decontaminate as dc
from tokenlake.llm.common import read_table

SF = "/root/testdata/sf0.001"


def brute_scores(items, passage):
    """BM25 of every segment, by the formula."""
    segments = [w[a : a + dc.SEGMENT_WORDS] for _, t in items for w in [t.split()] for a in range(0, len(w), dc.SEGMENT_WORDS)]
    df = Counter(x for s in segments for x in set(s))
    mean = sum(map(len, segments)) / len(segments)
    out = []
    for s in segments:
        tf = Counter(s)
        weight = {x: math.log(1 + (len(segments) - df[x] + 0.5) / (df[x] + 0.5)) * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * len(s) / mean)) for x, n in tf.items()}
        out.append((sum(weight[x] for x in set(passage) if x in weight), dc.SHARE * sum(weight.values())))
    return out


def test_pruned_retrieval_equals_scoring_everything():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 150)))) for k in range(90)]
    index = dc.build_index(items)
    for _ in range(60):
        passage = rng.choices(words, k=100)
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            passage[5:] = part[: rng.randint(1, len(part))]
        terms = np.unique(dc.SpanHashes().words(" ".join(passage).encode())[1])
        place = np.searchsorted(index.terms, terms)
        hit = (place < len(index.terms)) & (index.terms[np.minimum(place, len(index.terms) - 1)] == terms)
        _, segment, score = dc.retrieve(index, np.zeros(hit.sum(), np.int64), place[hit])
        want = {k: s for k, (s, least) in enumerate(brute_scores(items, passage)) if s >= least - 1e-9}
        assert dict(zip(segment.tolist(), score.tolist(), strict=True)).keys() == want.keys()
        assert all(abs(s - want[k]) < 1e-6 for k, s in zip(segment.tolist(), score.tolist(), strict=True))


def test_every_item_in_a_document_is_found_and_no_clean_document(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    flat = lambda t: f" {' '.join((t or '').split())} "
    texts, parts = [(d.doc_id, flat(d.text)) for d in docs.collect()], [(i.item_id, flat(i.text)) for i in items.collect()]
    whole = {(d, i) for d, t in texts for i, x in parts if x.strip() and x in t}
    assert whole and whole <= got
    text, part = dict(texts), dict(parts)
    for d, i in got - whole:
        assert min(dc.overlaps(part[i].encode().split(), text[d].encode().split())) >= dc.OVERLAP


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "few words"), (4, "few words")],
                                  "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in dc.find_leaks(docs, items).collect())
    assert got == sorted([("1", "1")] * 2 + [("None", "1")] + [(d, i) for d in ("8", "-9") for i in ("None", "4")])
    assert dc.find_leaks(empty(docs), items).count() == 0 and dc.find_leaks(docs, empty(items)).count() == 0
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6 + 0


def test_separated_and_half_copied_items_equal_brute_force(spark):
    """Every pair that overlaps() confirms is found, wherever the shingles stand in the document."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(6000)]
    some = lambda n: rng.choices(words, k=n)
    items = [(k, some(n)) for k, n in enumerate([1, 3, 4, 5, 7, 9, 10, 11, 15, 20, 30, 45, 59, 130, 300] * 3)]
    items += [(100 + k, items[12][1][:30] + some(20)) for k in range(3)]  # the question of another item
    texts = []
    for _, w in items:
        half = (len(w) + 1) // 2
        texts.append(some(40) + w[:half] + some(200) + w[half:] + some(40))  # question and answer apart
        texts.append(some(30) + w[half // 2 : half + (len(w) - half) // 2 + 3] + some(30))  # a contiguous part of each
        cuts = [w[a : a + 9] for a in range(0, len(w), 10)]
        texts.append([x for c in cuts for x in c + some(150)])  # pieces all over the document
        texts.append(w[:half] + some(100))  # the question alone
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    coded = [([x.encode() for x in t]) for t in texts]
    want = {(d, i) for i, w in items for d, t in enumerate(coded) if min(dc.overlaps([x.encode() for x in w], t)) >= dc.OVERLAP}
    rows = dc.find_leaks(docs, benchmark).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.item_id) for r in rows} == want
    assert {i for d, i in want if d % 4 == 0} >= {i for i, w in items if len(w) >= 2 * dc.SHINGLE}


def test_scores_do_not_depend_on_the_batches(spark, monkeypatch):
    """The same pairs and scores with the benchmark in one index and in many."""
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    odd = spark.createDataFrame([(90_001, None), (90_002, "two words"), (90_003, ""), (90_002, "two words")], items.schema)
    items = items.unionByName(odd)
    more = spark.createDataFrame([(70_000, "here two words stand", None, None, None)], docs.schema)
    docs = docs.unionByName(more)
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in dc.find_leaks(docs, items).collect())
    whole = rows()
    assert len(whole) >= 5 and (70_000, 90_002) in {r[:2] for r in whole}
    monkeypatch.setattr(dc, "MAX_INDEX_WORDS", 150)
    assert len(list(dc._batches_of_items(items))) > 3 and rows() == whole
