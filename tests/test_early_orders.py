"""Orders from before 1995 keep their rows: block 1 is the day of the first order then."""

import os

import duckdb
import pytest

from test_registry import _rows
from tokenlake.plans import registry as R

SF = "/root/testdata/sf0.001"
NAMES = ["ingest_counters", "missing_header_quarantine", "insert_ignore", "processed_blocks_upsert", "feed_snapshot", "forced_restart", "aggregates_all"]


@pytest.fixture(scope="module")
def early(tmp_path_factory):
    """The small tables with every third order moved two years back, before 1995 for many."""
    path = str(tmp_path_factory.mktemp("early"))
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/{t}.parquet')) TO '{path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 YEAR ELSE o_orderdate END AS o_orderdate)
                          FROM read_parquet('{SF}/orders.parquet')) TO '{path}/orders.parquet' (FORMAT parquet)""")
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(path, t)}.parquet')")
    assert con.execute("SELECT min(o_orderdate) < DATE '1995-01-01' FROM orders").fetchone()[0]
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_early_orders_are_kept(spark, early, name):
    path, con = early
    df = R.queries()[name](spark, path)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(R.oracle_sql()[name])
    assert rows and _rows(df.columns, rows) == _rows([d[0] for d in res.description], res.fetchall())
