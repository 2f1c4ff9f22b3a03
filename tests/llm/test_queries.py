import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as cp
from tokenlake.llm import queries as Q
from tokenlake.llm.common import read_table, written

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "conversations", "labels", "benchmark"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows and rows_of(df.columns, rows) == rows_of(columns, found.fetchall())


def test_all_queries_are_registered():
    names = E.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_pipeline_stages_do_their_work(spark):
    """Each stage is held against a plain Python version on what the stage before it kept."""
    import test_decontaminate
    import test_probminhash
    import test_token_ids

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    out = {}
    for name, stage in cp.STAGES:
        out[name] = (docs, written(stage(spark, docs, SF), f"test-{name}"))
        docs = out[name][1]
        assert name == "token_output" or docs.columns == columns

    before, after = out["quality_classifier"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}

    before, after = out["near_dedup"]
    classes = test_probminhash.brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))

    before, after = out["decontamination"]
    flat = lambda t: f" {' '.join((t or '').split())} "
    items = [flat(i.text) for i in read_table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in before.collect() if not any(x in flat(r.text) for x in items)}
    assert {r.doc_id for r in after.collect()} <= clean and len(clean) - after.count() <= 2
    assert test_decontaminate.dc.find_leaks(after, read_table(spark, SF, "benchmark")).count() == 0

    before, after = out["mix_sources"]
    taken = {r.doc_id: r for r in Q.mixing.mix(before).collect()}
    copies = Counter(r.doc_id for r in after.collect())
    for i, r in taken.items():
        assert (copies[i] == 0) == (r.taken == 0)
        assert copies[i] * r.size >= r.taken > (copies[i] - 2) * r.size

    before, after = out["token_output"]
    got = sorted((tuple(r) for r in after.collect()), key=lambda r: r[1])
    assert got == test_token_ids.direct([(r.doc_id, r.text) for r in before.collect()])
