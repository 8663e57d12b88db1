from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.llm import url_filter as uf
from ledgerflow.llm.queries import URL_RULES

URLS = ["http://a.example.org/es/x", "http://example.org/en/19?q=1", "http://badexample.org/es/x", "HTTP://WWW.X.COM/de/1#f", "http://x.com/fr/2", "http://x.net/p/?utm_source=a&b=2&a=1#z",
        "x.net/p", "", None, "http://x.net/p?a=1&b=2", "://y.net", "http://x.net", "http://org/", "http://x.net/p?a=1&b=2"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({"host": F.lit(1), "_block": F.lit(2), "_canon": F.lit(3)})
    listed = spark.createDataFrame([("x.net/p?a=1&b=2",), ("nowhere.net",), (None,)], "canonical string")
    got = {r.page_id: r for r in uf.filter_urls(pages, listed, URL_RULES).collect()}
    assert len(got) == len(URLS)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[1].rule, got[1].verdict) == ("example.org/en/1", "block")
    assert (got[2].rule, got[2].verdict) == ("org/", "allow")
    assert (got[3].host, got[3].rule, got[3].verdict) == ("www.x.com", "com/de/", "block")
    assert (got[4].rule, got[4].verdict) == ("com/fr/", "allow")
    assert got[5].verdict == got[9].verdict == got[13].verdict == "block" and got[5].rule is None
    for i in (6, 7, 8):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    assert (got[10].host, got[10].path) == ("y.net", "") and (got[11].path, got[11].verdict) == ("", "allow")


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("site"), "id", F.lit(".net/p")).alias("canonical"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://site"), "id", F.lit(".net/p")).alias("url"))
    for limit in (32 << 20, 0):  # broadcast, and joined by block
        rows = uf.filter_urls(pages, listed, [], broadcast_bytes=limit).collect()
        assert all((r.verdict == "block") == (r.page_id < 5000) for r in rows) and len(rows) == 20_000
        assert sum(r.bloom_hit for r in rows if r.page_id >= 5000) < 0.02 * 15_000


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "canonical string")
    assert uf.filter_urls(none, listed, URL_RULES).count() == 0
    assert uf.filter_urls(spark.createDataFrame([(1, "http://a.b/c")], none.schema), listed, []).collect()[0].verdict == "allow"


def test_the_query_lists_urls_that_their_hosts_do_not_imply(spark, tmp_path):
    from ledgerflow.llm.queries import op6_url_filter
    page = lambda body: f"<html><article>{body}</article></html>"
    rows = [(1, "http://one.net/a", page("copied text")), (2, "http://two.net/b?utm_source=x", page("copied text")), (3, "http://two.net/c", page("own text")),
            (4, "http://two.net/b", "no article"), (5, "http://same.net/1", page("twice")), (6, "http://same.net/2", page("twice")), (7, None, page("copied text")),
            (8, "http://www.spam-farm.net/x", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
