import random

from pyspark.sql import functions as F

from tokenlake.llm import warc


def brute(records):
    def opaque(x):
        return x[2:] if x and x.startswith("W/") else x

    out = {}
    for rid, key, at, status, headers, digest, _ in records:
        if status != 304:
            continue
        full = [r for r in records if r[3] == 200 and r[1] == key and r[2] < at] if key is not None and at is not None else []
        if not full:
            out[rid] = ("no_response", None, None)
            continue
        best = max(full, key=lambda r: (r[2], r[0]))
        own, stored = headers or {}, best[4] or {}
        if "etag" in own:
            same = opaque(own["etag"]) == opaque(stored.get("etag"))
        elif "last-modified" in own:
            same = own["last-modified"] == stored.get("last-modified")
        else:
            same = None
        outcome = {True: "resolved", False: "mismatch", None: "unverified"}[same]
        merged = None if same is False else stored | {k: v for k, v in own.items() if k not in warc.NOT_UPDATED}
        out[rid] = (outcome, best[0], merged)
    return out


def test_as_of_join_equals_the_definition(spark):
    rng = random.Random(7)
    records = []
    for i in range(600):
        key = rng.choice(["a.test/x", "a.test/x", "b.test", "c.test/y?z=1"])
        status = rng.choice([200, 304, 304])
        headers = rng.choice([None, {}, {"etag": rng.choice(['"1"', 'W/"1"', '"2"'])}, {"last-modified": rng.choice("mn"), "content-length": "0", "date": "d"}])
        records.append((f"r{i:04}", key, rng.randrange(20_000) if key != "b.test" else rng.randrange(50), status, headers, f"d{i}", i))
    spelled = [(r[0], rng.choice(["http://", "https://"]) + rng.choice(["", "x"])[:0] + r[1].replace("a.test", rng.choice(["a.test", "A.TEST", "a.test:80"]))
                + rng.choice(["", "#f"]), *r[2:]) for r in records]
    rows = spark.createDataFrame(spelled, warc.RECORD).repartition(4)
    for seconds in (3600, 7, 10**6):
        got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in warc.resolve_revisits(rows, seconds).collect()}
        assert got == brute(records)


def test_odd_records(spark):
    rows = [
        ("a", None, 5, 304, {"etag": '"1"'}, None, None), ("b", "http://x/", None, 304, None, None, None), ("c", "http://x", 3, 200, None, "d", 1),
        ("e", "http://x/", 4, 304, None, None, None), ("e", "http://x/", 4, 304, None, None, None), ("f", "http://x/", 3, 304, None, None, None),
        ("g", "http://x/", 9, 404, None, None, None), (None, "http://x/", 9, 304, {"etag": '"1"'}, None, None), ("h", "x", 9, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, warc.RECORD)
    got = sorted((str(r.record_id), r.outcome) for r in warc.resolve_revisits(df).collect())
    assert got == [("None", "mismatch"), ("a", "no_response"), ("b", "no_response"), ("e", "unverified"), ("e", "unverified"), ("f", "no_response")]
    assert warc.resolve_revisits(df.filter("false")).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://x/", None), (None, "http://y", "h"), (2, "http://x/", None)], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.records_of_pages(pages)).count() >= 8


def test_header_names_in_any_case(spark):
    rows = [
        ("a", "http://x", 3, 200, {"ETag": '"1"', "Content-Type": "t"}, "d", 1), ("b", "http://x/", 4, 304, {"ETAG": 'W/"1"', "CONTENT-TYPE": "u", "Date": "now"}, None, None),
        ("c", "http://x/", 5, 304, {"Etag": '"2"'}, None, None), ("e", "http://x/", 6, 304, {"etag": '"2"', "ETag": '"1"'}, None, None),
        ("f", "http://x/", 7, 304, {"ETAG": '"2"', "ETag": '"1"'}, None, None),
    ]
    got = {r.record_id: (r.outcome, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got["b"] == ("resolved", {"etag": 'W/"1"', "content-type": "t", "date": "now"})
    assert got["c"][0] == "mismatch" and got["e"][0] == "mismatch" and got["f"][0] == "resolved"


def test_clashing_names_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://x/" + "p" * 100_000, "h" * 100_000)], "page_id long, url string, html string")
    records = warc.records_of_pages(pages)
    for clash in ("url_key", "slice", "full", "found", "carried", "newest", "outcome"):
        records = records.withColumn(clash, F.lit("clash"))
    assert {r.outcome for r in warc.resolve_revisits(records).collect()} == {"resolved"}
