import random
from datetime import datetime, timedelta

from tokenlake.operators import callstats as CS
from tokenlake.schemas import CALL_LOG_SCHEMA


def brute_streaks(rows, threshold):
    out = []
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[7])):
        by.setdefault(r[0], []).append(r)
    for p, rs in by.items():
        run = []
        for r in rs + [None]:
            if r is not None and not r[4]:
                run.append(r)
                continue
            if len(run) >= threshold:
                out.append((p, run[0][7], run[-1][7], len(run)))
            run = []
    return sorted(out)


def make_log(n, seed, fail_p=0.5):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows, t = [], t0
    for i in range(n):
        t += timedelta(seconds=rnd.choice([1, 30, 600, 3600, 7200]))
        ok = rnd.random() > fail_p
        p = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b"])
        rows.append((p, "eth_getLogs", t, rnd.random() * 3, ok, None if ok else "timeout", i, i))
    return rows


def test_streaks_match_brute_force_across_buckets(spark):
    rows = make_log(3000, 7, fail_p=0.7)
    df = spark.createDataFrame(rows, CALL_LOG_SCHEMA)
    for th in (1, 2, 3, 5):
        got = sorted((r.provider, r.start_seq, r.end_seq, r.length) for r in CS.failure_streaks(df, th).collect())
        assert got == brute_streaks(rows, th), th


def test_streak_spanning_many_all_failed_buckets(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("p", "m", t0 + timedelta(hours=h), 0.1, h in (0, 9), None, h, h) for h in range(10)]
    df = spark.createDataFrame(rows, CALL_LOG_SCHEMA)
    got = [(r.start_seq, r.end_seq, r.length) for r in CS.failure_streaks(df, 5).collect()]
    assert got == [(1, 8, 8)]


def test_histogram_cumulative(spark):
    rows = [("p", "m", datetime(2024, 1, 1), d, True, None, 1, i) for i, d in enumerate([0.05, 0.3, 0.7, 3.0, 40.0])]
    h = CS.duration_histogram(spark.createDataFrame(rows, CALL_LOG_SCHEMA), (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0))
    got = {r.le: r.cumulative_count for r in h.collect()}
    assert got == {"0.1": 1, "0.5": 2, "1": 3, "2": 3, "5": 4, "10": 4, "30": 4, "+Inf": 5}


def test_height_is_latest(spark):
    t = datetime(2024, 1, 1)
    rows = [("p", "m", t, 0.1, True, None, 5, 1), ("p", "m", t, 0.1, True, None, 3, 2),
            ("p", "m", t - timedelta(1), 0.1, True, None, 9, 3)]
    assert CS.block_height(spark.createDataFrame(rows, CALL_LOG_SCHEMA)).first().height == 3
