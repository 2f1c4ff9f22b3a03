from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenlake.functions import uint256 as U

EDGES = [0, 1, 10**18 - 1, 10**18, 10**38 - 1, 10**38, 2**128, 2**255, 2**256 - 1,
         10**34 - 1, 10**34 + 1, 12345 * 10**30, 10**40, 10**9 - 1, 10**9]


def _decode(spark, values):
    rows = [(i, format(v, "064x")) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, h string")
    d = U.with_value_parts(df, "h").withColumn("s", U.parts_to_string(F.col("value_parts")))
    d = d.withColumn("ok", U.dec128_ok(F.col("s")))
    d = d.withColumn("d", U.value_dec128(F.col("s"), F.col("ok")).cast("string"))
    return {r.i: r for r in d.collect()}


def _dec128(v):
    ok = len(str(v).rstrip("0")) <= 34
    return ok, ((str(v) if v < 10**38 else None) if ok else "0")


def test_edges_exact(spark):
    out = _decode(spark, EDGES)
    for i, v in enumerate(EDGES):
        assert out[i].s == str(v)
        assert (out[i].ok, out[i].d) == _dec128(v)


def test_wide_values_are_zero_in_dec128(spark):
    out = _decode(spark, [2**256 - 1, 10**34 + 1, 12345 * 10**30, 10**40])
    assert out[0].d == "0" and out[1].d == "0"
    assert out[2].d == str(12345 * 10**30)
    assert out[3].ok is True and out[3].d is None  # fits Decimal128, not DECIMAL(38,0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2**256 - 1), min_size=1, max_size=200))
def test_random_values_and_group_sums(spark, values):
    rows = [(i % 3, format(v, "064x")) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, h string")
    d = U.with_value_parts(df, "h")
    got = [r.s for r in d.select(U.parts_to_string(F.col("value_parts")).alias("s")).collect()]
    assert sorted(got) == sorted(str(v) for v in values)
    sums = U.carried_sum_string(d.groupBy("g").agg(*U.sum_parts_exprs(F.col("value_parts"))))
    expected = {}
    for i, v in enumerate(values):
        expected[i % 3] = expected.get(i % 3, 0) + v
    assert {r.g: int(r.total) for r in sums.collect()} == expected


def test_text_to_parts_round_trip(spark):
    vals = [0, 7, 10**40 + 3, 2**256 - 1]
    df = spark.createDataFrame([(str(v),) for v in vals], "s string")
    back = df.select(U.parts_to_string(U.parts_from_decimal_text(F.col("s"))).alias("t"))
    assert sorted(r.t for r in back.collect()) == sorted(str(v) for v in vals)


def test_empty_sum_is_null(spark):
    df = spark.createDataFrame([("0" * 64,)], "h string")
    d = U.with_value_parts(df, "h").where("false")
    assert U.carried_sum_string(d.agg(*U.sum_parts_exprs(F.col("value_parts")))).first().total is None


def test_no_python_in_decode_plan(spark):
    df = spark.createDataFrame([("f" * 64,)], "h string")
    plan = U.with_value_parts(df, "h")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_scaled_double_is_correctly_rounded(spark):
    import random
    from fractions import Fraction

    rnd = random.Random(3)
    vals = [0, 1, 10**18, 10**18 + 1, 2**256 - 1, 123456789] + [rnd.getrandbits(rnd.randint(1, 256)) for _ in range(500)]
    df = spark.createDataFrame([(str(v),) for v in vals], "s string")
    got = [r.d for r in df.select(U.scaled_double(F.col("s")).alias("d")).collect()]
    assert got == [float(Fraction(v, 10**18)) for v in vals]
