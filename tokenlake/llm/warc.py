"""Resolution of not-modified revisits in web archives (operator 5).

A revisit record says that a url had not changed and carries no body. It is joined as of its time to
the latest earlier full response of the same canonical url; if the validators agree (weak comparison of
ETags, else Last-Modified), the record becomes that response with the headers that a 304 may update.

The as-of join is done in two steps, so that a url with a third of all records is no single group: the
last response before each record within (url, time slice), and for records without one in their slice
the last response of the slices before, of which there is one row per url and slice.

Defined results: no earlier response (or a null url or time): ``no_response``; validators that differ:
``mismatch``; a revisit without validators: ``unverified``, resolved all the same; a response at the same
second is not earlier; among responses of one second the largest record_id counts; repeated records
are resolved one by one; null headers are empty; header names count in lower case; urls of any length are keys as they are;
other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.url_filter import host_of, path_of, rest_of

SLICE_SECONDS = 3600
# fixed values: fields of a stored response that a 304 must not change
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
RECORD = "record_id string, url string, at long, status int, headers map<string,string>, payload_digest string, payload_bytes long"


def canonical_url(url: Column) -> Column:
    """Host without default port, path without closing slash, query; scheme, fragment and letter case of the host do not count."""
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), query))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only the last by code point counts, lower case first of all."""
    lowered = F.transform(F.array_sort(F.map_entries(headers)), lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))
    last = F.filter(lowered, lambda h, i: ~F.exists(F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == h["key"]))
    odd = F.exists(F.map_keys(headers), lambda k: k != F.lower(k))
    return F.when(odd, F.map_from_entries(last)).otherwise(headers)


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers, updated by those of the revisit that may change."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(record_id, url_key, at, outcome, response_id, response_at, payload_digest, payload_bytes, headers) of every revisit.

    ``records`` has RECORD's columns, header names in any case; status 304 is a revisit, 200 a full response.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    rows = (
        records.select(*names)
        .filter(F.col("status").isin(200, 304))
        .withColumn("headers", F.coalesce(lower_names(F.col("headers")), F.expr("cast(map() as map<string,string>)")))
        .withColumn("url_key", canonical_url(F.col("url")))
        .withColumn("slice", F.floor(F.col("at") / slice_seconds))
        .withColumn("full", F.col("status") == 200)
    )
    loose = F.col("url_key").isNull() | F.col("at").isNull()
    kept = F.struct("record_id", "at", "headers", "payload_digest", "payload_bytes")
    response = F.when(F.col("full"), kept)
    keyed = rows.filter(~loose)
    within = Window.partitionBy("url_key", "slice").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = keyed.groupBy("url_key", "slice").agg(F.max_by(response, F.when(F.col("full"), F.struct("at", "record_id"))).alias("newest"))
    carried = newest.select("url_key", "slice", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    revisits = keyed.withColumn("found", F.last(response, ignorenulls=True).over(within)).filter("NOT full")
    found = revisits.join(carried, ["url_key", "slice"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried")
    nothing = rows.filter(loose & ~F.col("full")).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    return _outcomes(found.unionByName(nothing))


def _outcomes(found: DataFrame) -> DataFrame:
    own, stored = F.col("headers"), F.col("found.headers")
    etag, modified = own["etag"], own["last-modified"]
    agrees = F.when(etag.isNotNull(), _opaque(etag).eqNullSafe(_opaque(stored["etag"]))).when(
        modified.isNotNull(), modified.eqNullSafe(stored["last-modified"])
    )
    outcome = (
        F.when(F.col("found").isNull(), "no_response").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    )
    taken = F.col("outcome").isin("resolved", "unverified")
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "at", "outcome",
        F.col("found.record_id").alias("response_id"),
        F.col("found.at").alias("response_at"),
        F.when(taken, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(taken, F.col("found.payload_bytes")).alias("payload_bytes"),
        F.when(taken, merged_headers(stored, own)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive derived from ``pages``: each page as a full response and, by its id, as two to four revisits.

    The first revisit has the page's ETag in weak form, the second only its Last-Modified under another
    scheme, the third (every third page) an ETag that has changed, the fourth (every fifth) comes before
    the response.
    """
    t0 = F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(10_000)) * 600
    base = pages.select(
        "page_id", "url", t0.cast("long").alias("t0"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"),
    )

    def head(**fields: Column) -> Column:
        pairs = [(k.replace("_", "-"), v) for k, v in fields.items()]
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs]))

    t, etag = F.col("t0"), F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    fresh, none, whole = F.lit("max-age=600"), F.lit(0), F.lit(True)
    other = F.when(F.startswith("url", F.lit("https:")), F.regexp_replace("url", "^https:", "http:")).otherwise(F.regexp_replace("url", "^http:", "https:"))
    kinds = [
        (0, 200, "url", t, head(content_type=F.lit("text/html"), content_length=F.col("size"), etag=etag, last_modified=t - 86400, date=t,
                                cache_control=F.lit("max-age=60")), whole),
        (1, 304, F.concat("url", F.lit("#again")), t + 18_000, head(etag=F.concat(F.lit("W/"), etag), date=t + 18_000, cache_control=fresh,
                                                                    content_length=none), whole),
        (2, 304, other, t + 108_000, head(last_modified=t - 86400, date=t + 108_000, cache_control=fresh), whole),
        (3, 304, "url", t + 180_000, head(etag=F.lit('"changed"'), date=t + 180_000), F.col("page_id") % 3 == 0),
        (4, 304, "url", t - 100, head(etag=etag, date=t - 100), F.col("page_id") % 5 == 0),
    ]
    entries = [
        F.when(
            when,
            F.struct(
                F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(f"-{k}")).alias("record_id"),
                (F.col(url) if isinstance(url, str) else url).alias("url"), at.cast("long").alias("at"), F.lit(status).alias("status"),
                headers.alias("headers"), F.when(F.lit(k == 0), F.col("digest")).alias("payload_digest"),
                F.when(F.lit(k == 0), F.col("size")).alias("payload_bytes"),
            ),
        )
        for k, status, url, at, headers, when in kinds
    ]
    return base.select(F.explode(F.filter(F.array(*entries), lambda r: r.isNotNull())).alias("r")).select("r.*")
