import hashlib
import zlib

from llm_rows import awkward, empty
from pyspark.sql import functions as F

from tokenlake.llm import manifest as m


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in m.FIELDS)))


def climb(nodes):
    """All levels, by the definition: every 2 consecutive ones become their hash while there are several."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = range(i // 2 * 2, min(i // 2 * 2 + 2, len(level)))
        yield [level[j] for j in run if j < i], [level[j] for j in run if j > i]
        i //= 2


def brute(rows, claimed):
    """{(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)} by whole trees in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in groups[name]]) for name in names]
    top = climb([t[-1][0] for t in trees]) if trees else []
    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            told, seen = leaf(claimed(r)), []
            for left, right in [*path(trees[g], i), *path(top, g)]:
                seen += left + right
                told = H(*left, told, *right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H(*seen), told, told == top[-1][0]))
    return sorted(out, key=str)


def tampered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
    return r | {"n_chars": r["n_chars"] + 1 if hit and r["n_chars"] is not None else r["n_chars"]}


def found(docs, step):
    claim = {"n_chars": F.expr("IF(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 0, n_chars + 1, n_chars)")}
    return sorted((tuple(r) for r in m.verify(m.proofs(m.leaves(docs, claim), step)).collect()), key=str)


def test_every_step_gives_the_trees_of_the_definition(spark):
    """Groups of 1, 2, 3, 7, 8, 33 and 70 rows; subtrees of 2, 8 and 1024 nodes."""
    sizes = {None: 3, "": 1, "a": 2, "b": 7, "é": 8, "z": 33, "en": 70}
    rows = [(100 * g + i, "s", name, i if i % 3 else None, f"text {i}") for g, (name, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    want = brute([r.asDict() for r in docs.collect()], tampered)
    assert {r[-1] for r in want} == {True, False}
    for step in (1, 3, 10):
        assert found(docs, step) == want


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    assert found(docs, 2) == brute([r.asDict() for r in docs.collect()], tampered)
    assert found(empty(docs), 2) == []


def test_one_lang_and_one_row(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = m.verify(m.proofs(m.leaves(docs))).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == H()


def test_equal_rows_spread_and_any_change_is_found(spark):
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                    F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    rows = m.leaves(docs)
    spread = m.numbered(rows, ["doc_id", "digest"])
    assert sorted(r.idx for r in spread.collect()) == list(range(3000))
    assert spread.select(F.max("n")).first()[0] == 3000
    assert all(r.verified for r in m.verify(m.proofs(rows)).collect())
    forged = m.leaves(docs, {"text": F.lit("other")})
    assert not any(r.verified for r in m.verify(m.proofs(forged)).collect())
