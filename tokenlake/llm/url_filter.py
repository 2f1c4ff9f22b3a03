"""URL filter with redirect equivalence (operator 9).

A rule (host, path, action) fits its host and all subdomains where the url's path starts with the
rule's path; the longest fitting rule decides. Urls without a rule take the decision of their aliases:
urls are nodes under an alias key (scheme, a leading ``www.`` or ``m.``, fragment, tracking parameters and a closing
slash do not count; that such urls are one is a guess, not an edge that a page states), canonical links and refresh redirects in the html are edges between keys, and
connected components gather the aliases. In a component, one explicit allow wins over any block.

Everything is DataFrame operations; urls are judged once each, however many pages have them.

Defined results: null url or one without ``://``: empty host and path, no rule, and no alias but
itself; such pages are allowed. Repeated rows are kept; other columns, whatever their names, are ignored; urls and html of any
length are read whole. Null html has no links, and neither have comments and scripts. Links are resolved against
the page's url, or its ``base`` element; links of other schemes without ``://`` and to the page itself tie nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm.common import written
from tokenlake.llm.components import connected_components

# fixed values: the rules of the query contract
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
TRACKING = r"(?<=[?&])(utm_[^&#]*|ref=[^&#]*)(&|$)"
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?((?:&(?:amp|#38|#x26);|[^\"'\s>;])+)"
BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: comments and scripts hold no links; one that is not closed reaches to the end
HIDDEN = r"(?is)<!--(?:.*?-->|.*\z)|<script\b(?:.*?</script|.*\z)"
AMPERSAND = r"(?i)&(amp|#38|#x26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """One string for urls that servers redirect to each other as a rule; the url itself where it has no host."""
    # a label goes only if two are left: www.org and m.com are sites of their own
    host = F.regexp_replace(host_of(url), r"^(www|m)\.([^.]+\..)", "$2")
    query = F.regexp_replace(F.regexp_extract(rest_of(url), r"^[^?#]*(\?[^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, r"[?&]$", "")
    key = F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), query)
    return F.when(host_of(url) == "", F.concat(F.lit("="), F.coalesce(url, F.lit("")))).otherwise(key)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as literals of the plan."""
    names = ("rule_host", "rule_path", "action")
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in rules])))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(ukey, rule, action) for the urls (ukey, host, path) that a rule fits: the longest, allow before block."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    return (
        urls.select("ukey", "path", F.explode(suffixes).alias("rule_host"))
        .join(named, "rule_host")
        .filter(F.startswith("path", "rule_path"))
        .groupBy("ukey")
        .agg(F.max(F.struct(F.length("rule"), (F.col("action") == "allow").alias("allow"), "rule", "action")).alias("best"))
        .select("ukey", "best.rule", "best.action")
    )


def without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments carried out; the first segment, before the leading slash, stays."""
    up = lambda kept: F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))
    closed = F.regexp_replace(path, r"/(\.\.?)$", "/$1/")
    return F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/")


def resolved(href: Column, url: Column) -> Column:
    """The link as a whole url, by the url (with a host) that it stands in; null if it leads to no other url."""
    href = F.regexp_replace(href, AMPERSAND, "&")
    root = F.concat(F.substring(url, F.lit(1), F.instr(url, "://") + 2), F.regexp_extract(rest_of(url), r"^[^/?#]*", 0))
    path, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"^/(.*/)?", 1))
    return (
        F.when(href.rlike(SCHEME + "//"), href)
        .when(href.rlike(SCHEME) | href.rlike("^(#|$)"), F.lit(None))
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, SCHEME, 0), href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path_of(url), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, without_dots(path), tail))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), tail))
    )


def html_links(pages: DataFrame) -> DataFrame:
    """(u, v): alias keys that a canonical link or a refresh redirect in the html ties together."""
    marked = pages.filter(F.col("html").rlike("(?i)canonical|refresh") & (host_of(F.col("url")) != ""))
    marked = marked.select("url", F.regexp_replace("html", HIDDEN, " ").alias("html"))
    to = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    own = lambda x: F.explode(F.array(x))  # noqa: E731  a step of its own: not copied into each place that reads it
    base = F.col("base")
    rows = marked.select("url", to.alias("to"), F.regexp_extract("html", BASE, 1).alias("base"))
    rows = rows.select("url", "to", own(resolved(base, F.col("url"))).alias("base"))
    rows = rows.select("url", F.coalesce(base, "url").alias("base"), F.explode("to").alias("href"))
    rows = rows.select("url", own(resolved(F.col("href"), base)).alias("href")).filter(host_of(F.col("href")) != "")
    return rows.select(alias_key(F.col("url")).alias("u"), alias_key(F.col("href")).alias("v"))


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias) for every page; ``links`` adds edges (u, v) of alias keys."""
    pages = pages.select("page_id", "url", "html").withColumn("ukey", F.coalesce(F.concat(F.lit("="), F.col("url")), F.lit("")))
    urls = pages.select("ukey", "url").distinct().select(
        "ukey", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("node")
    )
    urls = written(urls.join(fitting_rules(urls, rules), "ukey", "left"), "urls")
    edges = html_links(pages)
    groups = connected_components(edges if links is None else edges.unionByName(links.select("u", "v")))
    urls = urls.join(groups, "node", "left").withColumn("alias", F.coalesce("component", "node"))
    decisions = urls.groupBy("alias").agg(
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"),
    )
    inherited = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    judged = urls.join(decisions, "alias").withColumn("verdict", F.coalesce("action", inherited))
    return pages.select("page_id", "ukey").join(judged, "ukey").select("page_id", "host", "path", "rule", "verdict", "alias")
