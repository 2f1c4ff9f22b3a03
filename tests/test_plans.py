from tokenlake.functions.params import TransferQueryParams
from tokenlake.operators import query as Q
from tokenlake.plans import registry as R
from tokenlake.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_nodes_in_any_query(spark):
    for name, q in R.queries().items():
        p = plan(q(spark, SF))
        assert "Python" not in p and "collect_set" not in p, name


def test_block_range_pushed_to_parquet(spark):
    raw = V.raw_logs(spark, SF)
    p = plan(raw.where("block_number between 100 and 200"))
    assert "PushedFilters: [IsNotNull(block_number), GreaterThanOrEqual(block_number,100)" in p


def test_topic_filter_pushed_to_parquet(spark):
    from tokenlake.operators import decode as D

    p = plan(D.scan_transfer_logs(V.raw_logs(spark, SF), 100, 200))
    assert "EqualTo(topic0,0xddf252ad" in p


def test_store_scan_prunes_partitions_and_columns(spark):
    t = V.stored_transfers(spark, SF)
    df = Q.page_total(t, TransferQueryParams(start_block=100, end_block=200))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(block_bucket" in p
    assert "ReadSchema: struct<block_number:bigint>" in p


def test_dedup_limits_before_shuffle(spark):
    p = plan(V.deduped_transfers(spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_paging_is_top_k(spark):
    p = plan(Q.page(V.stored_transfers(spark, SF), TransferQueryParams(limit=10, offset=5)))
    assert "TakeOrderedAndProject" in p


def test_amounts_decoded_after_dedup(spark):
    p = plan(V.deduped_transfers(spark, SF))
    # top-down plan text: the uint256 words (conv) are computed above the dedup window
    assert p.index("conv(") < p.index("Window [row_number()")
