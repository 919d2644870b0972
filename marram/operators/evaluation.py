"""Evaluation of results against cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions import urls
from marram.functions.text import fold, text


def evaluate(cases: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a case: whether it passed, and what its results count.

    cases has id, min_results, expected_domains, expected_any_terms and expected_source_types; results has id, title,
    content, url, source_type, citation_url, extraction_method, published_at and primary_source_candidate; runs has id,
    status_code and latency_seconds. A case passes with status 200, enough results, and each expectation met by some.
    """
    none = F.array().cast("array<string>")
    want = lambda c: F.coalesce(F.col(c), none)
    some = lambda c: text(F.col(c)) != ""
    domain = urls.domain(F.col("url"))
    body = fold(F.concat_ws("\n", "title", "content"))
    low = lambda c: F.transform(want(c), lambda x: fold(x))
    rows = results.join(cases.select("id", "expected_domains", "expected_any_terms", "expected_source_types"), "id")
    agg = rows.groupBy("id").agg(
        F.count("*").alias("result_count"),
        F.countDistinct(F.nullif(urls.root_domain(domain), F.lit(""))).alias("independent_source_count"),
        F.count_if("primary_source_candidate").alias("primary_source_count"),
        F.count_if(some("published_at")).alias("dated_source_count"),
        F.count_if(some("extraction_method")).alias("extracted_source_count"),
        F.count_if(some("citation_url") | some("url")).alias("citation_count"),
        F.bool_or(F.exists(low("expected_domains"), lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d)))).alias("d"),
        F.bool_or(F.exists(low("expected_any_terms"), lambda t: body.contains(t))).alias("t"),
        F.bool_or(F.array_contains(want("expected_source_types"), F.col("source_type"))).alias("s"),
    )
    out = cases.join(runs, "id", "left").join(agg, "id", "left")
    met = lambda flag, c: (F.size(want(c)) == 0) | F.coalesce(F.col(flag), F.lit(False))
    counts = ["result_count", "independent_source_count", "primary_source_count", "dated_source_count", "extracted_source_count", "citation_count"]
    out = out.select("id", "status_code", F.round("latency_seconds", 3).alias("latency_seconds"), "min_results", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], met("d", "expected_domains").alias("expected_domain_hit"), met("t", "expected_any_terms").alias("expected_term_hit"), met("s", "expected_source_types").alias("expected_source_type_hit"))
    hit = F.col("expected_domain_hit") & F.col("expected_term_hit") & F.col("expected_source_type_hit")
    passed = F.coalesce(F.col("status_code") == 200, F.lit(False)) & (F.col("result_count") >= F.coalesce("min_results", F.lit(1))) & hit
    return out.withColumn("passed", passed).drop("min_results")


def report(rows: DataFrame) -> DataFrame:
    """One row over all cases: pass rate and coverage, as shares of all results."""
    share = lambda c: F.round(F.sum(c) / F.greatest(F.lit(1), F.sum("result_count")), 4)
    return rows.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), share("citation_count").alias("citation_coverage"), share("extracted_source_count").alias("extraction_coverage"), share("primary_source_count").alias("primary_source_coverage"), share("dated_source_count").alias("dated_source_coverage"))
