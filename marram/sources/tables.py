"""Explicit schemas of the engine's tables, and readers and sinks of them. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.text import text

REQUESTS = "request_id string, query string, mode string, max_results int, language string, time_range string, categories array<string>, as_of timestamp"
RAW_HITS = "request_id string, variant_ix int, variant string, ix long, rank int, title string, url string, content string, published_raw string, modified_raw string, engine string, engines array<string>"
PAGES = "request_id string, page_index int, url string, html string, content_type string"

#: Budgets of modes: hits, pages, followed links, results. Fixed values.
BUDGETS = (("quick", 12, 3, 0, 4), ("balanced", 24, 6, 1, 6), ("deep", 30, 8, 2, 8), ("integrated", 16, 3, 0, 5))
URLS, SCRAPE_CHARS, SCRAPE_BYTES, SCRAPE_LINKS = 8192, 300_000, 4_194_304, 500


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table of one of the schemas, from parquet, json, orc or csv; columns that the schema doesn't have aren't read."""
    return spark.read.schema(schema).format(kind).load(path)


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUDGETS, "mode string, hits int, pages int, follows int, results int")


def searx_view(candidates: DataFrame) -> DataFrame:
    """Candidates under the names of a meta-search result."""
    return candidates.select("request_id", "url", "title", F.col("snippet").alias("content"), F.lit("gateway").alias("engine"), F.col("discovery_score").alias("score"), F.col("published_at").alias("publishedDate"))


def search_envelope(results: DataFrame) -> DataFrame:
    """One row a request: number_of_results, and the results in order as an array."""
    rest = [c for c in results.columns if c not in ("request_id", "position")]
    packed = results.groupBy("request_id").agg(F.count("*").alias("number_of_results"), F.array_sort(F.collect_list(F.struct("position", *rest))).alias("results"))
    return packed


def truncate_utf8(value: Column, most: int) -> Column:
    """At most so many bytes, without a part of a character: up to three bytes more go than need to."""
    raw = F.encode(text(value), "UTF-8")
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)], F.lit(""))
    return F.when(F.octet_length(raw) <= most, text(value)).otherwise(whole)


def scrape_document(pages: DataFrame) -> DataFrame:
    """(url, markdown, links): page-declared facts first, then the text, cut by characters, then by bytes."""
    facts = F.array_compact(F.array(*[F.concat(F.lit(f"- {name}: "), F.nullif(F.col(c), F.lit(""))) for name, c in (("Published", "published_at"), ("Modified", "modified_at"), ("Author", "author"), ("Language", "language"))]))
    block = F.when(F.size(facts) > 0, F.concat(F.lit("Page-declared metadata:\n"), F.array_join(facts, "\n"), F.lit("\n\n"))).otherwise("")
    whole = F.substring(F.concat(block, text(F.col("content"))), 1, SCRAPE_CHARS)
    return pages.select("url", truncate_utf8(whole, SCRAPE_BYTES).alias("markdown"), F.slice("links", 1, SCRAPE_LINKS).alias("links"))
