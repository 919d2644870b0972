"""What a query asks for, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules
from marram.functions.text import has, squeeze, text


def mode_for(query: Column, requested: Column) -> Column:
    words = F.size(F.filter(F.split(text(query), r"[\t\n\f\r ]+"), lambda w: w != ""))
    auto = F.when(has(query, "technical") | has(query, "recommendation"), "balanced").when(words <= 9, "quick").otherwise("balanced")
    return F.when(requested != "auto", requested).otherwise(auto)


def search_categories(query: Column, given: Column | None = None) -> Column:
    pick = lambda intent, name: F.when(has(query, intent), F.lit(name))
    own = F.array_compact(F.array(F.lit("general"), pick("technical", "it"), pick("current", "news"), pick("academic", "science"), pick("image", "images")))
    return own if given is None else F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(own)


def search_engines(query: Column, categories: Column, variant: Column) -> Column:
    """Engines for a variant of a query in its categories."""
    names = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    there = lambda c: F.array_contains(categories, c)
    special = there("it") & ~text(variant).rlike(r"(?i)(?:^|\s)site:\S+")
    parts = [
        names(*rules.BROAD_ENGINES),
        F.when(special & has(query, "web_platform"), names("mdn")).otherwise(none),
        F.when(special & (has(query, "programming") | has(query, "troubleshoot")), names("stackoverflow")).otherwise(none),
        F.when(special & has(query, "ubuntu"), names("askubuntu")).otherwise(none),
        F.when(there("news"), names(*rules.NEWS_ENGINES)).otherwise(none),
        F.when(there("science"), names(*rules.ACADEMIC_ENGINES)).otherwise(none),
        F.when(there("images"), names(*rules.IMAGE_ENGINES)).otherwise(none),
    ]
    only = F.array_distinct(categories) == names("images")
    return F.when(only, names(*rules.IMAGE_ENGINES)).otherwise(F.array_distinct(F.concat(*parts)))


def query_variants(query: Column, mode: Column, anchored: Column | None = None, strict: Column | None = None) -> Column:
    """Variants to search for, the anchored form first where there is an anchor; two, or three in deep mode."""
    q = squeeze(query)
    anchor = F.lit(None).cast("string") if anchored is None else anchored
    strict = F.lit(False) if strict is None else strict
    error = F.nullif(F.trim(F.regexp_extract(q, "(?i)" + rules.ERROR_QUOTE, 1)), F.lit(""))
    more = lambda words: F.concat(q, F.lit(" " + words))
    third = (
        F.when(has(q, "docker_documentation"), more("site:docs.docker.com"))
        .when(has(q, "technical") & has(q, "instruction"), more("official documentation"))
        .when(has(q, "current"), more("latest"))
        .when(anchor.isNotNull(), q)
        .when(has(q, "technical"), more("official documentation"))
    )
    found = F.array_compact(F.array(F.coalesce(anchor, q), F.when(~strict, F.concat(F.lit('"'), error, F.lit('"'))), third))
    deep = F.when((mode == "deep") & (F.size(found) < 3), F.concat(found, F.array(more("authoritative sources")))).otherwise(found)
    return F.slice(F.array_distinct(deep), F.lit(1), F.when(mode == "deep", 3).otherwise(2))
