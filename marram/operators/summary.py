"""Coverage of results and quality of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram.functions import urls
from marram.functions.dates import temporal_requirement
from marram.functions.text import has, text

DIVERSITY = "Limited independent-source diversity."
PRIMARY = "No likely primary or authoritative source was identified."
DATED = "The request is time-sensitive, but sources exposed no usable publication or modification dates."
VERSIONS = "No explicit software or product version context was extracted."
SNIPPETS = "Some results rely on search snippets because page extraction was unavailable."


def evidence_summary(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per row of requests (request_id, query): counts of its results, status and warnings.

    results has request_id, position, url, primary_source_candidate, published_at, modified_at, declared_at,
    extraction_method, citation_url and version_context. Requests without results have counts of zero.
    """
    some = lambda c: text(F.col(c)) != ""
    owner = F.nullif(urls.root_domain(urls.host(F.col("url"))), F.lit(""))
    versions = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("version_context", F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))
    agg = results.groupBy("request_id").agg(
        F.count("*").alias("result_count"),
        F.countDistinct(owner).alias("independent_source_count"),
        F.count_if(F.col("primary_source_candidate")).alias("primary_source_candidate_count"),
        F.count_if(some("published_at") | some("modified_at") | some("declared_at")).alias("dated_source_count"),
        F.count_if(some("extraction_method")).alias("extracted_source_count"),
        F.count_if(some("citation_url")).alias("citation_url_count"),
        F.array_distinct(versions).alias("_versions"),
    )
    out = requests.select("request_id", "query").join(agg, "request_id", "left")
    counts = ["result_count", "independent_source_count", "primary_source_candidate_count", "dated_source_count", "extracted_source_count", "citation_url_count"]
    out = out.select("request_id", "query", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("_versions", F.array().cast("array<string>")).alias("_versions"))
    need = temporal_requirement(F.col("query"))
    n, owners, primary = F.col("result_count"), F.col("independent_source_count"), F.col("primary_source_candidate_count")
    warn = lambda test, words: F.when(test, F.lit(words))
    warnings = F.array_compact(F.array(
        warn((n > 1) & (owners < 2), DIVERSITY), warn((n > 0) & (primary == 0), PRIMARY), warn((need == "high") & (F.col("dated_source_count") == 0), DATED),
        warn((need != "none") & (F.size("_versions") == 0) & has(F.col("query"), "version_sensitive"), VERSIONS), warn(F.col("extracted_source_count") < n, SNIPPETS),
    ))
    status = F.when((n > 0) & ((owners >= 2) | (primary > 0)), "sufficient").otherwise("limited")
    return out.select("request_id", status.alias("status"), *counts, need.alias("temporal_requirement"), F.slice("_versions", 1, 12).alias("version_contexts"), warnings.alias("warnings"))


def latency_summary(rows: DataFrame, per: list[str]) -> DataFrame:
    """(per, cases, passed, pass_rate, median_latency, p95_latency) of rows with passed and latency.

    The 95th percentile is the value of rank round(0.95 n) - 1, halves to even, within bounds. Rows are counted by value
    first, and running counts find the ranks, so no group is held in one array.
    """
    counts = rows.groupBy(*per, "latency").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    whole = Window.partitionBy(*per)
    upto = whole.orderBy(F.asc_nulls_last("latency")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.sum(F.when(F.col("latency").isNotNull(), F.col("n")).otherwise(0)).over(whole)
    placed = counts.select(*per, "latency", "n", "passed", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("cases"), known.alias("known"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("latency")))
    last = F.greatest(F.lit(0), F.least(F.col("cases") - 1, F.bround(F.lit(0.95) * F.col("cases"), 0).cast("long") - 1))
    middle = (at(F.floor((F.col("known") - 1) / 2)) + at(F.floor(F.col("known") / 2))) / 2
    agg = placed.groupBy(*per).agg(F.sum("n").alias("cases"), F.sum("passed").cast("long").alias("passed"), middle.alias("median_latency"), F.when(F.max(last) < F.max("known"), at(last)).alias("p95_latency"))
    return agg.select(*per, "cases", "passed", F.round(F.col("passed") / F.col("cases"), 4).alias("pass_rate"), F.round("median_latency", 3).alias("median_latency"), F.round("p95_latency", 3).alias("p95_latency"))
