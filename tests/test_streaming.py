from marram.sources import tables
from marram.streaming import hits


def test_stream_dedups_and_ranks(spark, tmp_path):
    schema = "request_id string, ix long, url string, discovery_score double, seen_at timestamp"
    rows = [("q", 0, "https://A.com:443/x#1", 1.0), ("q", 1, "https://a.com/x", 9.0), ("q", 2, "https://b.com/", 2.0), ("q", 3, "nothing", 5.0)]
    df = spark.createDataFrame(rows, "request_id string, ix long, url string, discovery_score double").selectExpr("*", "timestamp'2026-01-01 00:00:00' as seen_at")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    query = hits.rank_batches(hits.fresh_hits(hits.stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/check", lambda b, n: got.extend(b.collect()))
    query.awaitTermination(60)
    assert sorted((r["url"], r["position"]) for r in got) in ([("https://a.com/x", 1), ("https://b.com/", 2)], [("https://a.com/x", 2), ("https://b.com/", 1)])


def test_sinks(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("aé日😀", 1)], "t string, n int")
    for most, want in ((10, "aé日😀"), (9, "aé日"), (6, "aé日"), (5, "aé"), (2, "a"), (1, "a"), (0, "")):
        assert row.select(tables.truncate_utf8(F.col("t"), most)).first()[0] == want
    page = spark.createDataFrame([("u", "body", "2026-01-01", None, "Ann", "", [("l", "x")] * 600)], "url string, content string, published_at string, modified_at string, author string, language string, links array<struct<url:string,anchor:string>>")
    doc = tables.scrape_document(page).first()
    assert doc["markdown"] == "Page-declared metadata:\n- Published: 2026-01-01\n- Author: Ann\n\nbody" and len(doc["links"]) == 500
    assert tables.budgets(spark).count() == 4
