import pytest
from pyspark.sql import functions as F

from marram.operators import evaluation, lines, links, policy


@pytest.mark.parametrize("url", ["http://127.0.0.1/", "http://localhost/", "http://10.0.0.8/x", "http://[::1]/", "http://169.254.169.254/latest", "http://metadata.google.internal/", "ftp://example.com/", "http://user:pw@example.com/", "http://example.com:22/", "http://0177.0.0.1/", "http://0x7f.1/", "http://2130706433/", "http://intranet/", "http://a_b.example.com/", "http://[64:ff9b::7f00:1]/", "http://[::ffff:10.0.0.1]/", "", None, "http://-a.example.com/"])
def test_hostile_urls(url):
    assert policy.url_fault(url)


def test_public_urls(spark):
    df = spark.createDataFrame([("https://example.com/x",), ("http://8.8.8.8:8080/",), ("http://bücher.example/",), ("http://9.9.9.9/",)], "u string")
    assert [r[0] for r in df.select(policy.url_policy(F.col("u"), denied=["9.9.9.0/24"])).collect()] == [None, None, None, "denied network"]


def test_url_credentials(spark):
    df = spark.createDataFrame([("HTTPS://a.com/p;jsessionid=abc/q?api_key=k1&x=1&next=a%26token%3Dt#f",), ("not a url",), (None,)], "u string")
    got = [tuple(r[0]) for r in df.select(policy.redact_url(F.col("u"))).collect()]
    assert got[0] == ("https://a.com/p;jsessionid=[REDACTED]/q?api_key=%5BREDACTED%5D&x=1&next=a%26token%3D%5BREDACTED%5D", 3) and got[1] == ("not a url", 0) and got[2] == ("", 0)


def test_follow_links(spark):
    at = lambda u, a: (u, a)
    pages = [("q", 0, "https://docs.example.com/a", [at("https://docs.example.com:443/install#x", "Install guide"), at("https://docs.example.com/install", "again"), at("https://other.com/install", "Install"), at("https://docs.example.com/a", "Install self"), at("https://example.com/contact", "contact install"), at("https://example.com/zzz", "zzz")])]
    pages = spark.createDataFrame(pages, "request_id string, page_index int, url string, links array<struct<url:string,anchor:string>>")
    requests = spark.createDataFrame([("q", "widget install")], "request_id string, query string")
    rows = links.follow_links(pages, requests, 3).collect()
    assert [(r["url"], r["score"]) for r in rows] == [("https://docs.example.com/install", 1.7)]


def test_passages(spark):
    row = ("q", 0, "Oil filter text.\n\n" + "\n\n".join(f"part {i} " + "x" * 2500 for i in range(12)), "T", None, "2026-01-01", None, None, ["1.2"], 2.0, 0.5)
    pages = spark.createDataFrame([row], "request_id string, page_index int, content string, title string, source_type string, published_at string, modified_at string, declared_at string, version_context array<string>, discovery_score double, source_authority double")
    requests = spark.createDataFrame([("q", "oil filter")], "request_id string, query string")
    got = links.passages(pages, requests).orderBy("position").collect()
    assert got[0]["lexical_score"] == 1.25 and got[0]["reranker_text"].startswith("Title: T\nSource type: general_web\nPublished: 2026-01-01\nVersion context: 1.2\n\nOil filter")
    assert [r["passage_index"] for r in got] == [0, 1, 2, 3, 4, 5, 6]


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", 2, ["docs.example.com"], ["Install"], ["documentation_candidate"]), ("b", 1, None, None, None)], "id string, min_results int, expected_domains array<string>, expected_any_terms array<string>, expected_source_types array<string>")
    results = [("a", "Install it", "x", "https://docs.example.com/1", "documentation_candidate", "https://docs.example.com/1", "direct", "2026-01-01", True), ("a", "Other", None, "https://example.org/", "general_web", None, None, None, False)]
    results = spark.createDataFrame(results, "id string, title string, content string, url string, source_type string, citation_url string, extraction_method string, published_at string, primary_source_candidate boolean")
    runs = spark.createDataFrame([("a", 200, 1.0), ("b", 200, 3.0)], "id string, status_code int, latency_seconds double")
    rows = evaluation.evaluate(cases, results, runs)
    got = {r["id"]: r for r in rows.collect()}
    assert got["a"]["passed"] and (got["a"]["independent_source_count"], got["a"]["primary_source_count"], got["a"]["citation_count"]) == (2, 1, 2)
    assert not got["b"]["passed"] and got["b"]["result_count"] == 0
    total = evaluation.report(rows).first()
    assert total["pass_rate"] == 0.5 and total["citation_coverage"] == 1.0


def test_lines(spark):
    docs = spark.createDataFrame([(1, " - Alpha\r\nalpha\n\n•  Beta 2021\nBETA 2021\nplain"), (2, None)], "doc_id long, text string")
    rows = lines.line_rows(docs).orderBy("ix").collect()
    assert [(r["ix"], r["line"]) for r in rows] == [(0, "Alpha"), (1, "Beta 2021"), (2, "plain")]
    flags = lines.line_rows(docs).select("line", lines.table_like(F.col("line"), lines.task_terms(F.lit("find plain things"))).alias("t")).collect()
    assert {r["line"]: r["t"] for r in flags} == {"Alpha": False, "Beta 2021": True, "plain": True}
    n = lambda *x: spark.range(1).select(lines.confidence(*map(F.lit, x))).first()[0]
    assert [n(1, 1, 0, 0, 0), n(0, 1, 20, 0, 0), n(0, 0, 0, 1, 0), n(0, 0, 0, 0, 501), n(0, 0, 0, 0, 55)] == ["high", "medium_high", "medium", "low", "very_low"]


def test_capture(spark):
    from marram.operators import network

    rows = [("https://example.com/api/x", "application/json", "xhr", True), ("https://example.com/page", "text/plain", "fetch", False), ("https://example.com/data/x", "text/plain", "", True), ("https://other.org/x", "application/json", "xhr", False), ("https://other.org/api", "application/json", "xhr", True), ("https://example.com/app.js", "application/json", "xhr", False), ("https://example.com/api", "text/html", "xhr", False), ("https://example.com/api", "application/json", "document", False), (None, None, None, False)]
    df = spark.createDataFrame(rows, "u string, c string, r string, want boolean")
    assert [r[0] for r in df.select(network.should_capture(F.col("u"), F.col("c"), F.col("r"), F.lit("www.example.com"))).collect()] == [r[3] for r in rows]
    one = lambda c: spark.range(1).select(c).first()[0]
    length = lambda e, n: one(network.bounded_length(F.lit(e), F.lit(n)))
    assert [length(None, "12"), length("gzip", "12"), length("identity", "0"), length("", "x"), length("", "99999999")] == [12, None, None, None, None]
    body = lambda b, f, d, t: one(network.decoded_body(F.lit(b), F.lit(f), F.lit(d), F.lit(t)))
    assert [body("aGk=", True, 10, 5.0), body("hi", False, 10, 5.0), body("hi", False, 1, 5.0), body("hi", False, 10, 0.0), body("!!", True, 10, 5.0)] == ["hi", "hi", None, None, None]
    url = lambda u: one(network.diagnostic_url(F.lit(u)))
    assert [url("https://me:pw@Example.com:8443/x?token=1"), url("data:abc"), url("")] == ["https://example.com:8443", "data", "unknown"]


def test_direct_candidates_and_cache(spark):
    from marram.operators import discovery, pages

    requests = spark.createDataFrame([("q", "read https://docs.docker.com/install/ and https://example.com now"), ("r", "no links")], "request_id string, query string")
    rows = discovery.direct_candidates(requests).orderBy("ix").collect()
    assert [(r["url"], r["title"], r["discovery_score"]) for r in rows] == [("https://docs.docker.com/install/", "docs.docker.com/install", 13.95), ("https://example.com/", "example.com/", 10.0)]
    key = pages.cache_key("scrape", F.col("u"))
    df = spark.createDataFrame([("a",), ("b",), (None,)], "u string").select("u", key.alias("cache_key"), F.lit("2026-01-01 01:00:00").cast("timestamp").alias("as_of"))
    cache = df.where("u is not null").select("cache_key", F.when(F.col("u") == "a", "2026-01-01 00:50:00").otherwise("2025-12-01").cast("timestamp").alias("cached_at"), F.lit("body").alias("result"))
    got = {r["u"]: (r["state"], r["result"]) for r in pages.lookup(df, cache).collect()}
    assert got == {"a": ("fresh", "body"), "b": ("expired", None), None: (None, None)}
