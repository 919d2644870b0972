"""Results of a request from its pages, the candidates that named them, and ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import dates, sources, urls
from marram.functions.text import text
from marram.operators.ranking import diversified, page_content

VERSIONS = 8


def document_score(ranking: Column, rerank: Column | None = None) -> Column:
    """The ranking score, or else that of the reranker; 0 if there is none or it isn't finite."""
    value = (F.coalesce(ranking, rerank) if rerank is not None else ranking).cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def all_pages(fetched: DataFrame, followed: DataFrame) -> DataFrame:
    """Fetched pages and those that were reached by following their links, which come after them."""
    last = fetched.groupBy("request_id").agg((F.max("page_index") + 1).alias("_from"))
    moved = followed.join(last, "request_id", "left").withColumn("page_index", F.col("page_index") + F.coalesce("_from", F.lit(0))).drop("_from")
    return fetched.unionByName(moved, allowMissingColumns=True)


def assembled(requests: DataFrame, pages: DataFrame, candidates: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """The limit best results of each request, one row each, by position.

    requests is (request_id, query). pages has request_id, page_index, url, title, published_at, modified_at, declared_at,
    version_context, extraction_method and content_chars; candidates has request_id, url, title, snippet, published_at,
    modified_at, source_type, source_tier, authority_score, primary_source_candidate, freshness_score, version_context,
    evidence_id and engines, one row a URL; passages has request_id, page_index, ix, text, ranking_score and rerank_score.

    A page without passages gives no result. Its content are its three best passages, its score is the best. What the page
    says of itself goes before what the search said; source facts are the search's, or told from the URL. The first page of
    each owner comes before all others.
    """
    scored = passages.withColumn("doc_score", document_score(F.col("ranking_score"), F.col("rerank_score")))
    per = ["request_id", "page_index"]
    best = page_content(scored, per, score="doc_score", ix="ix").join(scored.groupBy(*per).agg(F.min("ix").alias("first_ix")), per)
    own = pages.join(best, per)  # pages without passages stay behind
    named = candidates.select("request_id", "url", F.struct(*[c for c in candidates.columns if c not in ("request_id", "url")]).alias("search"))
    rows = own.join(named, ["request_id", "url"], "left").join(requests, "request_id")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("search.title"), F.lit("")), F.col("url"))
    rows = rows.withColumn("profile", sources.source_profile(F.col("url"), text(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("search.title"))), F.col("query")))
    rows = rows.withColumn("owner", urls.root_domain(urls.domain(F.col("url"))))
    picked = diversified(rows, ["request_id"], limit, score="page_score", ix="first_ix")
    none = F.array().cast("array<string>")
    versions = F.concat(F.coalesce("search.version_context", none), F.coalesce("version_context", none), dates.version_markers(F.col("title"), F.col("content")))
    engines = F.when(F.size("search.engines") > 0, F.col("search.engines")).otherwise(F.array(F.lit("search-gateway")))
    evidence = F.coalesce(F.nullif(F.col("search.evidence_id"), F.lit("")), urls.evidence_id(F.col("url")))
    fact = lambda name: F.coalesce(F.col(f"search.{name}"), F.col(f"profile.{name}"))
    return picked.select(
        "request_id", "position", "page_index", title.alias("title"), "url", "content", F.coalesce("search.snippet", F.lit("")).alias("snippet"), engines.alias("engines"),
        F.round("page_score", 6).alias("score"), F.coalesce("published_at", "search.published_at").alias("published_at"), F.coalesce("modified_at", "search.modified_at").alias("modified_at"), "declared_at",
        *[fact(n).alias(n) for n in ("source_type", "source_tier", "authority_score", "primary_source_candidate")], F.coalesce("search.freshness_score", F.lit(0.0)).alias("freshness_score"),
        F.slice(F.array_distinct(versions), 1, VERSIONS).alias("version_context"), evidence.alias("evidence_id"), F.col("url").alias("citation_url"), "extraction_method", "content_chars",
    )
