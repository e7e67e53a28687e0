"""The url filter: parts of urls, rules, what the tree generalises, merges and rejects, and its edge cases."""

from tabflow.llm.queries_audit import URL_RULES
from tabflow.llm.queries import SQL
from tabflow.llm.url_templates import Rule, judge_urls
from tests.conftest import rows
from tests.oracle import _rows

SCHEMA = "page_id long, url string, host string, path string, template string, n int, token string, `_salt` string, purity string, verdict int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "t", 1, "x", "y", "z", 2) for i, u in enumerate(urls)], SCHEMA)


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_parts_and_rules(spark):
    urls = ["HTTP://Www.Example.COM/en/1?x#y", "http://a.example.com/en/1", "http://example.com", "http://xexample.com/en/", "http://a.net/es/Q", "http://net/fr/", "http://a.net/ES/", "x://h?/p", "no url", "", None, "a://b://c"]
    got = verdicts(judge_urls(pages(spark, urls), URL_RULES))
    assert [got[i][:3] for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/"),
        ("a.example.com", "/en/1", "example.com/en/"),
        ("example.com", "", None),
        ("xexample.com", "/en/", "com/"),
        ("a.net", "/es/Q", "net/es/"),
        ("net", "/fr/", "net/fr/"),
        ("a.net", "/ES/", None),
        ("h", "", None),
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("b:", "//c", None),
    ]
    assert [got[i][3] for i in (0, 1, 3, 4, 5)] == ["allow", "block", "allow", "block", "block"]
    tied = [Rule("allow", "a.net", "/x"), Rule("block", "net", "/x123/")]
    assert verdicts(judge_urls(pages(spark, ["s://a.net/x123/y"]), [Rule("allow", "a.net", "/x"), Rule("block", "net", "/x1")]))[0][2:] == ("a.net/x", "allow")
    assert verdicts(judge_urls(pages(spark, ["s://a.net/x123/y"]), tied))[0][2:] == ("net/x123/", "block")


def test_rejection_reaches_urls_of_a_blocked_template_and_no_others(spark):
    rules = [Rule("block", "h.net", f"/shop/item-{d}") for d in "12345678"]
    bad = [f"s://h.net/shop/item-{k}" for k in range(10, 100)]
    good = [f"s://h.net/blog/{w}/" for w in ("alpha", "beta", "gamma")] + [f"s://h.net/news/{k}" for k in range(30)] + [f"s://other.net/shop/item-{k}" for k in range(90, 100)]
    got = judge_urls(pages(spark, bad + good), rules).collect()
    assert {r.verdict for r in got if r.path.startswith("/shop/") and r.host == "h.net"} == {"block"}
    assert any(r.rule is None and r.verdict == "block" for r in got)
    assert {r.verdict for r in got if not (r.path.startswith("/shop/") and r.host == "h.net")} == {"allow"}


def test_merges_alike_and_keeps_what_differs(spark):
    urls = [f"s://h.net/{w}/{k}" for w in ("en", "de", "es") for k in range(100, 140)] + [f"s://h.net/{w}" for w in ("one", "two")]
    got = {r.path: r.template for r in judge_urls(pages(spark, urls), [Rule("block", "h.net", "/es/")]).collect()}
    assert got["/en/100"] == got["/de/139"] == "/{de}/#" and got["/es/100"] == "/es/#" and got["/one"] == "/*"


def test_edge_cases(spark, write_tables):
    deep = "s://h.net/" + "/".join("abcdefghij") + "/" + "x" * 30_000
    urls = [None, "", deep, deep, "s://h.net/*/{a}", "s://h.net//", "s://h.net/"] + ["s://h.net/en/1"] * 20
    df = pages(spark, urls)
    got = judge_urls(df.union(df), URL_RULES)
    assert got.count() == 2 * len(urls) and rows(got.select("page_id").distinct()) == [(i,) for i in range(len(urls))]
    assert {r.template for r in got.filter("page_id = 7").collect()} == {"/*/*"}  # copies of one url are one path
    assert got.filter("page_id = 2").first().template == "/*/*/*/*/*/**"
    assert judge_urls(pages(spark, []), URL_RULES).count() == 0
    assert rows(judge_urls(df, []).select("rule").distinct()) == [(None,)]
    same_ids = judge_urls(spark.createDataFrame([(None, "s://a.net/x"), (None, None), (1, "s://a.net/es/x"), (1, "s://b.com/")], "page_id long, url string"), URL_RULES)
    assert rows(same_ids.select("page_id", "rule")) == [(None, None), (None, None), (1, "com/"), (1, "net/es/")]


def test_equals_its_sql_also_where_tables_are_shuffled(spark, monkeypatch):
    import duckdb

    from tabflow.llm import url_templates

    urls = [f"http://{h}.example.{t}/{w}/{k}{e}" for h in ("a", "www") for t in ("com", "net") for w in ("en", "es", "fr", "x9") for k in range(7, 21) for e in ("", "/", ".html")]
    urls += [f"http://a.example.net/{'/'.join('abcdefg'[:k])}" for k in range(7)] * 3 + [None, "x"]
    monkeypatch.setattr(url_templates, "measured", lambda df: df)
    got = judge_urls(pages(spark, urls), URL_RULES)
    con = duckdb.connect()
    pandas = pages(spark, urls).select("page_id", "url").toPandas()  # noqa: F841  read by DuckDB
    want = con.execute("WITH pages AS (SELECT page_id, url FROM pandas) SELECT * FROM (" + SQL["op11_url_templates"] + ")")
    names = [d[0] for d in want.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
