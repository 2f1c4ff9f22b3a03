import random

import pytest
from llm_rows import awkward, empty

from tokenlake.llm import importance as im
from tokenlake.llm.common import read_table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_kth_largest(spark, monkeypatch):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), 0.0, -50 + rng.random(), 3.25]) for _ in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").cache()
    monkeypatch.setattr(im, "FEW", 10)
    for k in (1, 2, 17, 2500, 4999, 5000):
        assert im.kth_largest(rows, "x", k) == sorted(values, reverse=True)[k - 1]


def test_held_out_labels(spark):
    """Fitted on even ids, judged on odd ones: no good document is lost, most rejects are found."""
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    kept = {r.doc_id: r.kept for r in im.resample(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.collect() if r.doc_id % 2 and r.doc_id in kept]
    good = [kept[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    bad = [kept[r.doc_id] for r in held if r.quality == 0 or r.toxic == 1]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.6


def test_documents_with_the_words_of_the_rejects_go(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=60) + (["Nasty", "vile"] if i % 6 == 0 else []))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], LABELS)
    first = im.resample(docs, labels).collect()
    assert {r.doc_id for r in first if not r.kept} == {i for i in range(900) if i % 6 == 0}
    assert sorted(map(str, first)) == sorted(map(str, im.resample(docs, labels).collect()))


def test_gumbel_noise(spark):
    noise = [r[0] for r in spark.range(20_000).select(im.gumbel(im.F.col("id"), 1)).collect()]
    assert sum(noise) / len(noise) == pytest.approx(0.5772, abs=0.03)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 1), (3, None, 0), (None, 1, 1), (5, 1, 0), (99, 1, 0)], LABELS)
    assert im.resample(docs, labels).count() == docs.count()
    assert im.keep_sampled(docs, labels).columns == docs.columns
    for d, x in ((empty(docs), labels), (docs, empty(labels))):
        assert all(r.kept for r in im.resample(d, x).collect())
    assert im.keep_sampled(docs, empty(labels)).count() == docs.count()


def test_few_labels_still_tell(spark):
    """Four rejects among 32 labels tell, and toxic = 1 without a quality is a label."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, k=30) + (["vile"] * (i % 8 == 0)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 8 == 0 else 1, int(i % 8 == 0)) for i in range(32)], LABELS)
    weight = {r.doc_id: r.log_weight for r in im.resample(docs, labels).collect()}
    bad = [w for i, w in weight.items() if i % 8 == 0 and i > 31]
    good = [w for i, w in weight.items() if i % 8 and i > 31]
    assert sum(bad) / len(bad) < sum(good) / len(good)


def test_held_out_toxic_and_good(spark):
    """Fitted on even ids, judged on odd ones; both signs and the noise act."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = im.resample(docs, labels.filter("doc_id % 2 = 0")).collect()
    kept = {r.doc_id: r.kept for r in rows}
    held = [r for r in labels.collect() if r.doc_id % 2 and r.doc_id in kept]
    rate = lambda fits: (lambda x: sum(x) / len(x))([kept[r.doc_id] for r in held if fits(r)])
    good, toxic, low = rate(lambda r: r.quality == 1 and r.toxic == 0), rate(lambda r: r.toxic == 1), rate(lambda r: r.quality == 0)
    print("held out, kept: good", good, "toxic", toxic, "low", low)
    assert good > 0.97 and toxic < 0.2 and low < 0.25
    assert min(r.log_weight for r in rows) < 0 < max(r.log_weight for r in rows)
    assert max(r.log_weight for r in rows if not r.kept) > min(r.log_weight for r in rows if r.kept)
