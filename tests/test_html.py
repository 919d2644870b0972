import pytest
from pyspark.sql import functions as F

from marram.functions import anchors, html
from marram.operators import discovery

PAGE = """<html lang="en"><head><title>Parts &amp; Service</title><meta name="author" content="Ann"><meta property="article:published_time" content="2026-01-02">
<script type="application/ld+json">{"@type": "Thing", "dateModified": "2026-02-03", "softwareVersion": "4.2.1"}</script><style>p{}</style></head>
<body><h1>Installation</h1><ol><li>Download<li>Run</ol><table><tr><th>Name<th>Size</tr><tr><td>a|b<td>2</tr></table><pre>x = 1
  y</pre><p hidden>gone</p><p aria-hidden="true">gone</p><div style="display: none">gone</div><input type=hidden value=gone>kept
<a href="/x#y">One <b>link</b></a><a href="/x">again</a><a href="mailto:a@b.c">m</a><noscript>gone</noscript><script>window.__X__ = {"name": "Oil Filter", "thread": "3/4-16"};</script></body></html>"""


def test_page():
    page = html.parsed(PAGE)
    text = html.page_text(page)
    for part in ("Title: Parts & Service", "# Installation", "1. Download", "2. Run", "| Name | Size |\n| --- | --- |\n| a\\|b | 2 |", "```\nx = 1\n  y\n```", "kept", "name: Oil Filter", "thread: 3/4-16"):
        assert part in text
    assert "gone" not in text and "window" not in text
    facts = html.declared(page)
    assert (facts["author"], facts["published"], facts["modified"], facts["version"], facts["language"], facts["title"]) == ("Ann", "2026-01-02", "2026-02-03", "4.2.1", "en", "Parts & Service")
    assert html.page_links(page, "https://example.com/a") == [{"url": "https://example.com/x", "anchor": "One link"}]


def test_json():
    assert html.json_or_text('{"product": {"name": "Widget", "sizes": ["S", "M"], "@id": 1}}').split("\n") == ["product:", "name: Widget", "sizes:", "S", "M"]
    assert html.json_or_text(" plain ") == "plain" and html.json_or_text(None) == "" and html.json_or_text("[" * 100_000) == "[" * 100_000


def test_broken_html():
    assert "Head" in html.page_text(html.parsed("<title>T</title><h1>Head<p>body<div><<>")) and html.page_text(html.parsed(None)) == ""


@pytest.mark.parametrize(
    ("query", "anchor", "strict"),
    [
        ('what is "Path of Exile" about', "Path of Exile", True),
        ("best build for Path of Exile 2 today", "Path of Exile 2", True),
        ("review of AW3426DW monitor", "AW3426DW", True),
        ("does my TV support HDR", "TV", False),
        ("how to boil eggs", None, False),
    ],
)
def test_anchor(query, anchor, strict):
    assert anchors.anchor_of(query) == anchor and anchors.strict_anchor(query, anchor) == strict


def test_discovery(spark):
    hits = [
        ("q", 0, 1, "Path-of-Exile-2 guide", "https://a.example.com/x", "the guide to builds", None),
        ("q", 1, 2, "Path of Exile 20", "https://b.example.com/x", "builds", None),
        ("q", 2, 1, "Path of Exile 2 builds", "https://a.example.com/x#top", "builds", "2026-01-01"),
        ("q", 3, 4, "Path of Exile 2", "https://www.pinterest.com/x", "builds", None),
        ("q", 4, 5, "", "https://c.example.com/", "Path of Exile 2", None),
        ("q", 5, 6, "Path of Exile 2", "ftp://c.example.com/", "builds", None),
    ]
    hits = spark.createDataFrame(hits, "request_id string, ix int, rank int, title string, url string, content string, published_raw string").withColumn("modified_raw", F.lit(None).cast("string"))
    requests = spark.createDataFrame([("q", "latest builds for Path of Exile 2", None)], "request_id string, query string, time_range string").withColumn("as_of", F.lit("2026-01-10").cast("timestamp"))
    rows = discovery.discover(requests, hits).collect()
    assert [(r["url"], r["first_seen_ix"], r["ix"], r["topic_strict"]) for r in rows] == [("https://a.example.com/x", 0, 2, True)]
    assert rows[0]["published_at"] == "2026-01-01" and rows[0]["freshness_score"] == 0.9
