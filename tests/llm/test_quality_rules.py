import random
import re

from llm_rows import awkward, empty

from tokenlake.llm import quality_rules as qr


def brute_repeats(words):
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for s in spots.values() if len(s) > 1 for i in s for k in range(8)})


def test_repeated_words():
    rng = random.Random(4)
    for n in (0, 7, 8, 9, 16, 60, 200):
        for k in (1, 2, 3, 50):
            words = [b"w%d" % rng.randrange(k) for _ in range(n)]
            assert qr.repeated_words(words) == brute_repeats(words)


def test_counts_follow_the_contract():
    text = "a b\x0bc\n\na b\x0bc\n \u00a0x# é*\r\na b\x0bc\n" + "## | <y>\u2003"
    n_words, word_chars, n_symbols, n_dup, *_ = qr.measure_text(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert (n_words, word_chars, n_symbols, n_dup) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), 2)


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (2, "short"), (3, "### " * 40 + good), (4, "same words again and again and so on " * 9), (5, (good + "\n") * 3)]
    book = qr.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    judged = {r.doc_id: (r.base, r.v1) for r in book.select("doc_id", qr.passes("base").alias("base"), qr.passes("v1").alias("v1")).collect()}
    assert judged[1] == (True, True) and judged[2] == (False, False) and judged[4] == (False, False) and judged[3][1] is False
    table = {r.rule: r for r in qr.ablations(book, "v1").collect()}
    assert set(table) == set(qr.POLICIES["v1"])
    bits = {r.doc_id: r.failures for r in book.collect()}
    for k, rule in enumerate(qr.POLICIES["v1"]):
        without = qr.mask("v1") & ~(1 << k)
        assert table[rule].n_failed == sum(bool(b >> k & 1) for b in bits.values())
        assert table[rule].kept_without == sum(not b & without for b in bits.values())
        assert table[rule].n_only == sum(b == 1 << k for b in bits.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = qr.judge(docs).collect()
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (2, 3, 4))
    assert qr.judge(empty(docs)).count() == 0 and qr.ablations(qr.ledger(empty(docs)), "v1").count() == 0


def test_ablation_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    texts = [good, good, "few words", " ".join(f"longerword{i} ###" for i in range(20)), "a b", None, good + " !!" * 40 + " # $ % & * <" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    book = qr.ledger(docs).cache()
    rows = book.collect()
    for r in qr.explain(book).collect():
        single = [name for i, name in enumerate(qr._rules()) if r.failures == 1 << i]
        assert r.only_rule == (single[0] if single else None)
        want = sum(x.failures in (0, r.failures) for x in rows) if single else None
        assert r.kept_without == want and r.kept == (r.failures == 0)
    assert {r.only_rule for r in qr.explain(book).collect()} >= {None, "few_words", "symbols"}
    assert qr.explain(qr.ledger(empty(awkward(spark)))).count() == 0
