"""Fetched pages: routing, usability, choice of the best attempt, chunks, cache states."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram import rules
from marram.functions.text import squeeze, text


def body_format(body: Column, content_type: Column) -> Column:
    """json, html or text, by media type and first characters."""
    media = F.lower(F.trim(F.substring_index(text(content_type), ";", 1)))
    b = text(body)
    return F.when(media.contains("json") | b.rlike(r"^(?U)\s*[{\[]"), "json").when(media.contains("html") | F.lower(F.substring(b, 1, 2000)).contains("<html"), "html").otherwise("text")


def usable(content: Column, least: int = 900) -> Column:
    """Long enough without runs of white space, and fewer than two marks of a challenge page at its start."""
    flat = squeeze(content)
    preview = F.lower(F.substring(flat, 1, 3000))
    marks = F.lit(0)
    for m in rules.CHALLENGE_MARKERS:
        marks = marks + preview.contains(m).cast("int")
    return (F.length(flat) >= least) & (marks < 2)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """One row a URL of (url, tier, content): the first usable tier (900, 500 and 400 characters), else the longest."""
    least = F.when(F.col("tier") == 1, 900).when(F.col("tier") == 2, 500).otherwise(400)
    flat = squeeze(F.col("content"))
    good = usable(F.col("content"), 0) & (F.length(flat) >= least)
    rows = attempts.withColumn("_good", good).withColumn("_size", F.length(text(F.col("content"))))
    w = Window.partitionBy("url").orderBy(F.desc("_good"), F.when(F.col("_good"), F.col("tier")), F.desc("_size"), "tier")
    rows = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select("url", "tier", F.col("_size").alias("content_chars"), (~F.col("_good")).alias("low_confidence"))


def cache_state(age_seconds: Column) -> Column:
    return F.when(age_seconds <= rules.FRESH_SECONDS, "fresh").when(age_seconds <= rules.STALE_SECONDS, "stale").otherwise("expired")


def chunk_text(value: str | None) -> list[str]:
    """Paragraphs, long ones by sentences, packed into chunks; a part longer than a chunk loses its tail."""
    size, parts = rules.PASSAGE_CHARS, []
    for block in re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", value or "")):
        block = block.strip()
        if block:
            parts += [block] if len(block) <= size else [s for s in re.split(r"(?<=[.!?])\s+", block) if s]
    out: list[str] = []
    room = -1
    for part in parts:
        part = part[:size]
        if out and len(part) + 2 <= room:
            out[-1] += "\n\n" + part
            room -= len(part) + 2
        else:
            out.append(part)
            room = size - len(part)
    return out[: rules.MAX_CHUNKS]


def _chunk_column(values: pd.Series) -> pd.Series:
    return values.map(chunk_text)


def chunks(value: Column) -> Column:
    return F.pandas_udf(_chunk_column, "array<string>")(value)


# --- fixed value ---
CACHE_SCHEMA = "quality-v6"


def cache_key(pipeline: str, *parts: Column) -> Column:
    """SHA-256 of the schema, the pipeline and the parts as JSON, in the order given; nulls are parts too."""
    named = [F.coalesce(p.cast("string"), F.lit("\x00")).alias(f"p{i}") for i, p in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(F.lit(pipeline).alias("pipeline"), F.lit(CACHE_SCHEMA).alias("schema"), *named)), 256)


def lookup(requests: DataFrame, cache: DataFrame, as_of: str = "as_of") -> DataFrame:
    """requests with the result and state of their cache entry: fresh, stale, expired, or null where there is none.

    cache is (cache_key, cached_at, result); the latest entry of a key counts, and expired results aren't handed out.
    """
    latest = cache.groupBy("cache_key").agg(F.max_by("result", "cached_at").alias("result"), F.max("cached_at").alias("cached_at"))
    out = requests.join(latest, "cache_key", "left")
    age = F.unix_seconds(F.col(as_of)) - F.unix_seconds("cached_at")
    out = out.withColumn("state", F.when(F.col("cached_at").isNotNull(), cache_state(age)))
    return out.withColumn("result", F.when(F.col("state") != "expired", F.col("result")))


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries (cache_key, cached_at, result): the latest of each key, of equal ones the larger result."""
    both = cache.select("cache_key", "cached_at", "result").unionByName(entries.select("cache_key", "cached_at", "result"))
    return both.groupBy("cache_key").agg(F.max(F.struct("cached_at", "result")).alias("x")).select("cache_key", "x.cached_at", "x.result")


def refreshed(found: DataFrame, fresh: Column, error: Column) -> DataFrame:
    """What each request of lookup gets: cache tells whether it comes from the cache (hit), a refresh (miss) or, as the
    refresh failed, from an older entry (stale-fallback), whose refresh_error says why. With neither the result is null."""
    out = found.withColumn("_error", error).withColumn("_fresh", fresh)
    hit, failed = F.col("state").eqNullSafe("fresh"), F.col("_error").isNotNull()
    spare = failed & F.col("result").isNotNull()
    out = out.withColumn("cache", F.when(hit, "hit").when(~failed, "miss").when(spare, "stale-fallback").otherwise("error"))
    out = out.withColumn("refresh_error", F.when(~hit, F.col("_error")))
    return out.withColumn("result", F.when(hit | spare, F.col("result")).when(~failed, F.col("_fresh"))).drop("_error", "_fresh")
