import random

from pyspark.sql import functions as F

from tokenlake.llm import url_filter as uf
from tokenlake.llm.components import connected_components

PAGES = "page_id long, url string, html string"


def verdicts(spark, rows, rules=uf.RULES, links=None):
    got = uf.judge_urls(spark.createDataFrame(rows, PAGES), uf.rule_table(spark, rules), links).collect()
    assert len(got) == len(rows)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_rules_hosts_and_paths(spark):
    urls = [
        "http://Ä.EXAMPLE.net/en/x?q#f", "https://example.net", "https://example.net/", "x://notexample.com/de/", "x://a.example.com/de/b",
        "x://a.org/fr/", "x://org/fr", "no scheme", None, "", "://", "a://b?c/d", "a://B.NET#/x", "a://u@Net:80/x", "a://b/c://d",
    ]
    got = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert got[0] == ("Ä.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "", None, "block")  # no rule of its own; its alias with a slash is blocked
    assert got[2][2:] == ("net/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "allow")
    assert all(got[i] == ("", "", None, "allow") for i in (7, 8, 9, 10))
    assert got[11][:2] == ("b", "") and got[12][:2] == ("b.net", "") and got[13][0] == "u@net:80" and got[14][:2] == ("b", "/c://d")


def test_blocks_reach_aliases_and_an_allow_wins(spark):
    canonical = '<html><LINK href="{}" rel=canonical></html>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.test/1", canonical.format("http://bad.net/x")), (2, "https://www.a.test/1/#f", None), (3, "http://bad.net/x", None),
        (4, "http://b.test/1", refresh.format("http://bad.net/y")), (5, "http://bad.net/y", canonical.format("http://ok.org/fr/z")),
        (6, "http://ok.org/fr/z", None), (7, "http://c.test/", "<link rel=stylesheet href=http://bad.net/x>"), (7, "http://c.test/", None),
    ]
    got = {}
    for r in uf.judge_urls(spark.createDataFrame(rows, PAGES), uf.rule_table(spark, uf.RULES)).collect():
        got.setdefault(r.page_id, []).append(r.verdict)
    assert {k: v[0] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow"}
    assert len(got[7]) == 2


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 600 + i) for i in range(80)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {x for x in up if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: root(x) for x in up if x not in loops}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert verdicts(spark, []) == {}


def test_links_are_resolved_against_the_page(spark):
    page = "HTTPS://www.a.test/d/e/p.html?q=1"
    forms = {
        "/de/x": "a.test/de/x", "x.html": "a.test/d/e/x.html", "//b.test/y": "b.test/y", "?n=2": "a.test/d/e/p.html?n=2", "./z": "a.test/d/e/z",
        "../z": "a.test/d/z", "../../../z": "a.test/z", "..": "a.test/d", "/m/./n/../o?u=../v": "a.test/m/o?u=../v", "x?u=http://c.test/": "a.test/d/e/x?u=http://c.test/",
        "http://b.test/y?a=1&amp;b=2": "b.test/y?a=1&b=2", "f?a=1&#38;b=2": "a.test/d/e/f?a=1&b=2", "mailto:m@b.test": None, "#part": None,
    }
    for html in ('<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0; url={}">'):
        rows = [(i, page, html.format(h)) for i, h in enumerate(forms)]
        got = sorted(r.v for r in uf.html_links(spark.createDataFrame(rows, PAGES)).collect())
        assert got == sorted(v for v in forms.values() if v)
    other = [(1, page, "<base href='/g/'><link rel=canonical href=h>"), (2, "http://a.test", "<link rel=canonical href=h>")]
    assert sorted(r.v for r in uf.html_links(spark.createDataFrame(other, PAGES)).collect()) == ["a.test/g/h", "a.test/h"]


def test_relative_refresh_to_a_blocked_path(spark):
    rows = [(1, "http://a.example.com/s", '<meta http-equiv="refresh" content="0; url=/de/x">'), (2, "http://a.example.com/de/x", None)]
    assert {k: v[3] for k, v in verdicts(spark, rows).items()} == {1: "block", 2: "block"}


def test_comments_scripts_and_short_hosts_tie_nothing(spark):
    link = "<link rel=canonical href=http://bad.net/x>"
    hidden = ["<!-- " + link + " -->", "<!--" + link, "<script>s='" + link + "'</script>", "<SCRIPT>" + link, "<!-- a --><p><!-- " + link + "-->"]
    shown = ["<!-- a -->" + link, "<script>a</script>" + link + "<!-- b -->"]
    rows = [(i, f"http://a.test/{i}", html) for i, html in enumerate(hidden + shown)]
    got = verdicts(spark, [*rows, (99, "http://bad.net/x", None)])
    assert [got[i][3] for i in range(len(rows))] == ["allow"] * len(hidden) + ["block"] * len(shown)
    urls = ["http://m.com/", "http://com/", "http://www.org/", "http://org/", "http://m.net/", "http://www.a.test/", "https://a.test"]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(uf.alias_key(F.col("u"))).collect()]
    assert keys == ["m.com", "com", "www.org", "org", "m.net", "a.test", "a.test"]


def test_long_inputs_and_clashing_names(spark):
    long = "<!-- " + "x" * 300_000 + "<!--" * 50_000 + "<link rel=canonical href=http://bad.net/x>"
    rows = spark.createDataFrame([(1, "http://a.test/" + "p" * 200_000, long), (None, None, None)], PAGES)
    for clash in ("host", "path", "rule", "verdict", "alias", "node", "component", "u", "v", "ukey", "base", "href", "action"):
        rows = rows.withColumn(clash, F.lit("clash"))
    got = {r.page_id: r.verdict for r in uf.judge_urls(rows, uf.rule_table(spark, uf.RULES)).collect()}
    assert got == {1: "allow", None: "allow"}
    assert uf.judge_urls(rows, uf.rule_table(spark, [])).count() == 2
