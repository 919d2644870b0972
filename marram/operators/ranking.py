"""Dedup, ranking, diversification and assembly of candidates, passages and pages. Every order has a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram import rules
from marram.functions.text import lexical_score, ranking_score


def dedup_candidates(hits: DataFrame, keys: list[str], score: str = "discovery_score", ix: str = "ix") -> DataFrame:
    """The best row of each key, the first of equal ones, with first_seen_ix, where the key was first seen."""
    rest = [c for c in hits.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(ix))).alias("best")
    out = hits.groupBy(*keys).agg(best, F.min(ix).alias("first_seen_ix"))
    return out.select(*keys, "best.*", "first_seen_ix")


def top_k(rows: DataFrame, order: list[Column], k: int, per: list[str] | None = None, into: str = "position") -> DataFrame:
    """The first k rows in order, of each group where per names one, with their places from 1."""
    if not per:
        rows = rows.orderBy(*order).limit(k)
    w = Window.partitionBy(*(per or [F.lit(0)])).orderBy(*order)
    return rows.withColumn(into, F.row_number().over(w)).where(F.col(into) <= k)


def lexical_rerank(docs: DataFrame, query: str, k: int, text: str = "text", authority: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rank documents by lexical score and authority; the query is one literal, so the scan does all the work."""
    q = F.lit(query)
    scored = docs.select(id_col, lexical_score(q, F.col(text)).alias("rerank_score"), (F.lit(0.0) if authority is None else authority).alias("_authority"))
    scored = scored.withColumn("ranking_score", ranking_score(F.col("rerank_score"), F.col("_authority"))).drop("_authority")
    return top_k(scored, [F.desc("ranking_score"), F.col(id_col)], k)


def rerank(docs: DataFrame, scores: DataFrame, keys: list[str], k: int, ix: str = "ix", lexical: str = "lexical_score", authority: str = "rank_authority", per: list[str] | None = None) -> DataFrame:
    """Rank by a model's scores (keys, model_score): rows with a finite score come first, then the others by lexical score."""
    best = scores.where(F.col("model_score").isNotNull() & ~F.isnan("model_score") & (F.abs("model_score") != float("inf"))).groupBy(*keys).agg(F.first("model_score").alias("model_score"))
    out = docs.join(best, keys, "left").withColumn("is_scored", F.col("model_score").isNotNull())
    out = out.withColumn("rerank_score", F.coalesce("model_score", lexical)).withColumn("ranking_score", ranking_score(F.col("rerank_score"), F.col(authority)))
    return top_k(out, [F.desc("is_scored"), F.desc("ranking_score"), F.col(ix)], k, per)


def rerank_status(requests: DataFrame, docs: DataFrame, scores: DataFrame, per: str = "request_id", ix: str = "ix") -> DataFrame:
    """(per, rerank_status) of each request (per, failure): ok where all documents have a model's finite score, partial where
    some have, fallback with the failure, or invalid_response, where none has, and empty without documents."""
    finite = scores.where(F.col("model_score").isNotNull() & ~F.isnan("model_score") & (F.abs("model_score") != float("inf")))
    rows = docs.select(per, ix).join(finite.select(per, ix, F.lit(1).alias("_one")).distinct(), [per, ix], "left")
    counts = rows.groupBy(per).agg(F.count("*").alias("_all"), F.count("_one").alias("_scored"))
    n, k = F.coalesce("_all", F.lit(0)), F.coalesce("_scored", F.lit(0))
    status = F.when(n == 0, "empty").when(k == 0, F.concat(F.lit("fallback:"), F.coalesce("failure", F.lit("invalid_response")))).when(k == n, "ok").otherwise("partial")
    return requests.join(counts, per, "left").select(per, status.alias("rerank_status"))


def prefilter_passages(passages: DataFrame, per: list[str] | None = None, ix: str = "ix", k: int = rules.MAX_PASSAGES) -> DataFrame:
    """Passages with a lexical score, or among the first of their page; the best k by lexical and source score."""
    kept = passages.where((F.col("lexical_score") > 0) | (F.col("passage_index") <= rules.EARLY_PASSAGES))
    return top_k(kept, [F.desc(F.col("lexical_score") + rules.SOURCE_WEIGHT * F.col("source_score")), F.col(ix)], k, per)


def top_passages(passages: DataFrame, per: list[str], k: int = rules.TOP_PASSAGES, score: str = "ranking_score", ix: str = "passage_index") -> DataFrame:
    return top_k(passages, [F.desc(score), F.col(ix)], k, per, "rank")


def page_content(passages: DataFrame, per: list[str], k: int = rules.TOP_PASSAGES, score: str = "ranking_score", ix: str = "passage_index") -> DataFrame:
    """(per, content, page_score): the k best passages joined by a blank line, cut, and the best score."""
    best = top_passages(passages, per, k, score, ix)
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return best.groupBy(*per).agg(F.substring(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n"), 1, rules.CONTENT_CHARS).alias("content"), F.max(score).alias("page_score"))


def diversified(pages: DataFrame, per: list[str], k: int, owner: str = "owner", score: str = "page_score", ix: str = "page_index") -> DataFrame:
    """Pages by score, the first page of each owner before all later ones; pages without owner never wait."""
    order = [F.desc(score), F.col(ix)]
    turn = F.row_number().over(Window.partitionBy(*per, owner).orderBy(*order))
    rows = pages.withColumn("_again", (F.col(owner) != "") & (turn > 1))
    return top_k(rows, [F.col("_again"), *order], k, per).drop("_again")


def snippet_fallback(results: DataFrame, candidates: DataFrame, per: list[str], k: int, ix: str = "ix") -> DataFrame:
    """(per, url, position, is_fallback): results, then candidates whose URL isn't among them, up to k."""
    spare = candidates.join(results.select(*per, "url"), [*per, "url"], "left_anti").select(*per, "url", F.lit(True).alias("is_fallback"), F.col(ix).alias("_ix"))
    both = results.select(*per, "url", F.lit(False).alias("is_fallback"), F.col("position").cast("long").alias("_ix")).unionByName(spare.withColumn("_ix", F.col("_ix").cast("long")))
    return top_k(both, [F.col("is_fallback"), F.col("_ix"), F.col("url")], k, per).drop("_ix")
