"""What a source is and what it weighs, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules
from marram.functions import urls
from marram.functions.text import fold, has, let, text


def source_adjustment(domain: Column) -> Column:
    """Boost of the first label, and boosts and penalties of all domains it is or is under."""
    first = F.substring_index(domain, ".", 1)
    out = F.lit(0.0)
    for label, value in rules.LABEL_BOOSTS.items():
        out = out + F.when(first == label, value).otherwise(0.0)
    for name, value in (rules.DOMAIN_BOOSTS | rules.DOMAIN_PENALTIES).items():
        out = out + F.when(urls.in_domains(domain, [name]), value).otherwise(0.0)
    return out


def _affinity(domain: Column, path: Column, title: Column, query: Column) -> Column:
    words = lambda x: F.regexp_extract_all(fold(x), F.lit("[a-z0-9]{3,}"), F.lit(0))
    asked = F.array_except(words(query), F.array(*map(F.lit, rules.AFFINITY_STOP)))
    return F.arrays_overlap(asked, words(F.concat_ws(" ", urls.root_domain(domain), F.substring(path, 1, 500), F.substring(text(title), 1, 500))))


def source_profile(url: Column, title: Column, query: Column) -> Column:
    """Struct of source_type, source_tier, authority_score, authority_adjustment, primary_source_candidate, query_domain_affinity."""
    d, p = urls.domain(url), urls.path(url)
    kind = lambda t, tier, score, primary: F.struct(F.lit(t).alias("t"), F.lit(tier).alias("tier"), F.lit(score).alias("score"), F.lit(primary).alias("primary"))

    def ladder(d: Column) -> Column:
        github = urls.in_domains(d, ["github.com"])
        return (
            F.when(d == "", kind("general_web", 5, 0.0, "no"))
            .when(urls.in_domains(d, rules.LOW_QUALITY_DOMAINS), kind("low_quality_or_social", 5, 0.08, "no"))
            .when(d.endswith(".gov") | d.contains(".gov.") | urls.in_domains(d, ["europa.eu"]), kind("government", 1, 0.96, "yes"))
            .when(urls.in_domains(d, rules.STANDARD_DOMAINS), kind("standard", 1, 0.95, "yes"))
            .when(urls.in_domains(d, rules.ACADEMIC_DOMAINS) | d.endswith(".edu") | d.contains(".edu."), kind("academic_primary", 1, 0.91, "yes"))
            .when(github & p.rlike("(?i)" + rules.DISCUSSION_PATH), kind("technical_community", 3, 0.66, "no"))
            .when(github & p.rlike("(?i)" + rules.RELEASE_PATH), kind("release_notes", 1, 0.9, "affine"))
            .when(github, kind("source_repository", 2, 0.84, "affine"))
            .when(urls.in_domains(d, rules.DOCUMENTATION_DOMAINS), kind("documentation_candidate", 1, 0.93, "yes"))
            .when(d.rlike(r"^(?:docs|developer|support)\.") | p.rlike("(?i)" + rules.DOCUMENTATION_PATH), kind("documentation_candidate", 2, 0.81, "affine"))
            .when(urls.in_domains(d, rules.TECHNICAL_DOMAINS), kind("technical_reference", 2, 0.78, "no"))
            .when(urls.in_domains(d, rules.NEWS_DOMAINS), kind("news", 2, 0.79, "no"))
            .when(urls.in_domains(d, rules.COMMUNITY_DOMAINS) | d.contains("forum"), kind("technical_community", 3, 0.61, "no"))
            .otherwise(kind("general_web", 4, 0.45, "no"))
        )

    def whole(k: Column, near: Column) -> Column:
        bonus = near & k["t"].isin("documentation_candidate", "release_notes", "source_repository")
        adjust = F.create_map(*[F.lit(x) for tier, v in rules.TIER_ADJUSTMENT.items() for x in (tier, v)])
        return F.struct(
            k["t"].alias("source_type"), k["tier"].alias("source_tier"),
            F.round(F.when(bonus, F.least(F.lit(1.0), k["score"] + 0.04)).otherwise(k["score"]), 4).alias("authority_score"),
            adjust[k["tier"]].alias("authority_adjustment"),
            ((k["primary"] == "yes") | ((k["primary"] == "affine") & near)).alias("primary_source_candidate"), near.alias("query_domain_affinity"),
        )

    return let(let(d, ladder), lambda k: let(_affinity(d, p, title, query), lambda near: whole(k, near)))


def intent_adjustment(query: Column, source_type: Column) -> Column:
    repo = (source_type == "source_repository") & ~has(query, "repository")
    by_type = F.when(source_type == "documentation_candidate", 0.9).when(source_type.isin("government", "standard", "technical_reference"), 0.35).when(repo, -1.25).otherwise(0.0)
    return F.when(has(query, "instruction"), by_type).otherwise(0.0)


def variant_adjustment(variant: Column, domain: Column, source_type: Column) -> Column:
    site = F.lower(F.regexp_replace(F.regexp_extract(text(variant), r"(?i)(?:^|\s)site:(\S+)", 1), r"^\.+|\.+$", ""))
    here = (site != "") & ((domain == site) | domain.endswith(F.concat(F.lit("."), site)))
    official = fold(variant).contains("official documentation") & (source_type == "documentation_candidate")
    return F.when(here, 0.8).when(official, 0.4).otherwise(0.0)
