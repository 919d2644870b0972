"""Links worth following, and passages of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions import urls
from marram.functions.text import fold, lexical_score, text
from marram.operators.pages import chunks
from marram.operators.ranking import prefilter_passages, top_k

# --- fixed values ---
LEAST_SCORE = 0.35
HELPFUL = r"(?iU)\b(?:docs?|guide|install|setup|config|manual|troubleshoot|faq|support)\b"
USELESS = r"(?i)(?:login|sign.?in|account|privacy|terms|contact|cart)"


def follow_score(query: Column, source: Column, url: Column, anchor: Column) -> Column:
    """Twice the lexical score of anchor and path, more for help, less for accounts; -10 for another owner's site."""
    body = F.concat_ws(" ", text(anchor), fold(urls.path(url)))
    score = 2.0 * lexical_score(query, body) + F.when(body.rlike(HELPFUL), 0.7).otherwise(0.0) - F.when(body.rlike(USELESS), 2.0).otherwise(0.0)
    return F.when(urls.root_domain(urls.domain(url)) == urls.root_domain(urls.domain(source)), score).otherwise(-10.0)


def follow_links(pages: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """(request_id, url, anchor, score, position): the best k unvisited links of each request's pages.

    pages has request_id, page_index, url and links. The first sighting of a URL that scores enough counts.
    """
    visited = pages.select("request_id", urls.canonical_url(F.col("url")).alias("url")).distinct()
    rows = pages.select("request_id", "page_index", F.col("url").alias("source"), F.posexplode("links").alias("link_ix", "link"))
    rows = rows.select("request_id", "page_index", "link_ix", "source", urls.canonical_url(F.col("link.url")).alias("url"), F.col("link.anchor").alias("anchor")).where(F.col("url").isNotNull())
    rows = rows.join(visited, ["request_id", "url"], "left_anti").join(requests.select("request_id", "query"), "request_id")
    rows = rows.withColumn("score", follow_score(F.col("query"), F.col("source"), F.col("url"), F.col("anchor"))).where(F.col("score") > LEAST_SCORE)
    first = Window.partitionBy("request_id", "url").orderBy("page_index", "link_ix")
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    best = top_k(rows, [F.desc("score"), F.col("page_index"), F.col("link_ix")], k, ["request_id"])
    return best.select("request_id", "url", "anchor", F.round("score", 6).alias("score"), "position")


def passages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """The passages of each request's pages that are worth ranking.

    pages has request_id, page_index, content, title, source_type, published_at, modified_at, declared_at,
    version_context, discovery_score and source_authority.
    """
    line = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"{name}: "), c))
    versions = F.array_join(F.slice(F.array_distinct(F.coalesce("version_context", F.array().cast("array<string>"))), 1, 8), ", ")
    context = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("Title: "), text(F.col("title"))), F.concat(F.lit("Source type: "), F.coalesce("source_type", F.lit("general_web"))),
        line("Published", F.col("published_at")), line("Modified", F.col("modified_at")), line("Page-declared date", F.col("declared_at")), line("Version context", versions),
    )), "\n")
    rows = pages.select("request_id", "page_index", context.alias("context"), F.coalesce("discovery_score", F.lit(0.0)).alias("source_score"), F.coalesce("source_authority", F.lit(0.0)).alias("rank_authority"), F.posexplode(chunks(F.col("content"))).alias("passage_index", "text"))
    rows = rows.join(requests.select("request_id", "query"), "request_id").withColumn("lexical_score", lexical_score(F.col("query"), F.col("text")))
    rows = rows.withColumn("ix", F.col("page_index") * 1000 + F.col("passage_index")).withColumn("reranker_text", F.concat_ws("\n\n", "context", "text"))
    return prefilter_passages(rows, ["request_id"]).drop("context", "query")
