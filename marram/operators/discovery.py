"""Discovery: requests joined to raw hits, filtered, scored and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram import rules
from marram.functions import anchors, dates, sources, urls
from marram.functions.text import contains_term, lexical_score, squeeze, subject_coverage, subject_terms, text, tokens
from marram.operators.ranking import dedup_candidates, top_k


def with_anchor(requests: DataFrame, query: str = "query") -> DataFrame:
    """requests with the struct topic, made once for each distinct query."""
    facts = requests.select(query).distinct().withColumn("topic", anchors.anchor_facts(F.col(query)))
    return requests.join(facts, query)


def anchor_matches(topic: Column, body: Column) -> Column:
    """Whether a text has the anchor: its parts in a row, an identifier of it, or all its tokens."""
    terms = tokens(topic["anchor"])
    ids = F.filter(terms, lambda t: (F.length(F.regexp_replace(t, "[^a-z0-9]", "")) >= 4) & t.rlike("[a-zA-Z]") & t.rlike(r"(?U)\d"))
    whole = F.coalesce(F.regexp_like(body, topic["pattern"]), F.lit(False))
    return whole | F.exists(ids, lambda t: contains_term(body, t)) | ((F.size(terms) > 0) & F.forall(terms, lambda t: contains_term(body, t)))


def normalized_hits(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that pass all filters, scored.

    requests has request_id, query, time_range, as_of and topic; hits has request_id, ix, rank, title, url, content,
    published_raw, modified_raw and, if it is known, the variant of the query that brought the hit. Filters are native and come before all scoring; the request side is the smaller one.
    """
    rows = hits.join(requests, "request_id")
    rows = rows.withColumn("raw_url", F.col("url")).withColumn("url", urls.canonical_url(F.col("url"))).withColumn("title", squeeze(F.col("title"))).withColumn("snippet", squeeze(F.col("content")))
    rows = rows.where(F.col("url").isNotNull() & (F.col("title") != "")).withColumn("domain", urls.domain(F.col("url")))
    banned = [d for d, v in rules.DOMAIN_PENALTIES.items() if v <= -3]
    rows = rows.where((F.col("domain") != "") & ~urls.in_domains(F.col("domain"), banned))
    body = F.concat_ws(" ", "title", "snippet", "url")
    topic, anchor = F.col("topic"), F.col("topic.anchor")
    rows = rows.withColumn("topic_match", anchor.isNull() | anchor_matches(topic, body)).where(F.col("topic_match") | ~F.col("topic.strict"))
    terms = F.when(anchor.isNull(), F.array().cast("array<string>")).otherwise(tokens(anchor))
    rows = rows.withColumn("topic_term_matches", F.size(F.filter(terms, lambda t: contains_term(body, t))))
    comparison = text(F.col("query")).rlike(r"(?iU)\b(?:compare|comparison|versus|vs\.?)(?:\b|$)")
    needed = F.when(F.col("topic.soft") & ~F.col("topic.strict"), 0).when(comparison, 1).otherwise(F.least(F.lit(2), F.size(terms)))
    rows = rows.where(F.col("topic_match") | (F.col("topic_term_matches") >= needed))
    rows = rows.withColumn("subject_coverage", subject_coverage(F.col("query"), body)).where((F.size(subject_terms(F.col("query"))) == 0) | (F.col("subject_coverage") > 0))
    rows = rows.withColumn("profile", sources.source_profile(F.col("url"), F.col("title"), F.col("query")))
    rows = rows.withColumn("published", dates.parse_date(F.col("published_raw"))).withColumn("modified", dates.parse_date(F.col("modified_raw")))
    need = dates.temporal_requirement(F.col("query"), F.col("time_range"))
    fresh = F.greatest(dates.freshness(F.col("published"), need, F.col("as_of")), dates.freshness(F.col("modified"), need, F.col("as_of")))
    rows = rows.withColumn("freshness_score", fresh).withColumn("intent_source_adjustment", sources.intent_adjustment(F.col("query"), F.col("profile.source_type")))
    plain = F.concat_ws(" ", text(F.col("title")), text(F.col("content")))
    authority = sources.source_adjustment(F.col("domain")) + F.col("profile.authority_adjustment") + F.col("intent_source_adjustment")
    topical = F.when(anchor.isNull(), 0.0).when(anchor_matches(topic, F.concat_ws(" ", plain, F.col("raw_url"))), 1.4).otherwise(-0.8)
    score = (
        3.0 * lexical_score(F.col("query"), plain) + 1.5 * subject_coverage(F.col("query"), F.concat_ws(" ", plain, F.col("raw_url")))
        + topical + 1.0 / F.greatest(F.lit(1), F.col("rank")) + authority + 0.55 * F.col("freshness_score")
    )
    if "variant" in hits.columns:  # hits of a variant that names a site or documentation count more where they fit it
        score = score + sources.variant_adjustment(F.col("variant"), F.col("domain"), F.col("profile.source_type"))
    return rows.select(
        "request_id", "ix", "url", "domain", F.substring("title", 1, 500).alias("title"), F.substring("snippet", 1, 1500).alias("snippet"),
        F.col("rank").alias("search_rank"), F.round(score, 4).alias("discovery_score"), F.round(authority, 4).alias("source_authority"),
        "profile.source_type", "profile.source_tier", "profile.authority_score", "profile.primary_source_candidate", "intent_source_adjustment",
        F.round("subject_coverage", 4).alias("subject_coverage"), anchor.alias("topic_anchor"), "topic_match", F.col("topic.strict").alias("topic_strict"), "topic_term_matches",
        dates.show_date(F.col("published")).alias("published_at"), dates.show_date(F.col("modified")).alias("modified_at"), "freshness_score",
        dates.version_markers(F.col("title"), F.col("snippet")).alias("version_context"), urls.evidence_id(F.col("url")).alias("evidence_id"), F.col("url").alias("citation_url"),
    )


def discover(requests: DataFrame, hits: DataFrame, limit: int = 30) -> DataFrame:
    """The best candidates of each request: normalized, one row a URL, by score; the first seen wins ties."""
    rows = normalized_hits(with_anchor(requests), hits)
    best = dedup_candidates(rows, ["request_id", "url"])
    return top_k(best, [F.desc("discovery_score"), F.col("first_seen_ix")], limit, ["request_id"])


def direct_candidates(requests: DataFrame, limit: int = 30) -> DataFrame:
    """URLs that a query names become its candidates and stand before any search: ten points and their authority."""
    rows = requests.select("request_id", "query", F.posexplode(F.slice(urls.extract_urls(F.col("query")), 1, limit)).alias("ix", "url"))
    rows = rows.withColumn("domain", urls.host(F.col("url"))).withColumn("title", F.concat("domain", F.coalesce(F.nullif(F.regexp_replace(urls.path(F.col("url")), "/+$", ""), F.lit("")), F.lit("/"))))
    rows = rows.withColumn("profile", sources.source_profile(F.col("url"), F.col("title"), F.col("query")))
    authority = sources.source_adjustment(F.col("domain")) + F.col("profile.authority_adjustment")
    return rows.select(
        "request_id", "ix", "url", "domain", "title", (F.col("ix") + 1).alias("search_rank"), F.round(10.0 + authority, 4).alias("discovery_score"), F.round(authority, 4).alias("source_authority"),
        "profile.source_type", "profile.source_tier", "profile.authority_score", "profile.primary_source_candidate",
        dates.version_markers(F.col("title")).alias("version_context"), urls.evidence_id(F.col("url")).alias("evidence_id"), F.col("url").alias("citation_url"), F.array(F.lit("direct-url")).alias("engines"),
    )


def with_direct(requests: DataFrame, hits: DataFrame, limit: int = 30) -> DataFrame:
    """Candidates of all requests: direct ones where the query names URLs, else discovered ones; the common columns."""
    direct = direct_candidates(requests, limit)
    named = direct.select("request_id").distinct()
    found = discover(requests.join(named, "request_id", "left_anti"), hits, limit)
    common = ["request_id", "url", "domain", "title", "search_rank", "discovery_score", "source_authority", "source_type", "source_tier", "primary_source_candidate", "evidence_id", "citation_url"]
    return direct.select(*common).unionByName(found.select(*common))
