"""URL filters: allow and block rules, then an empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, skew_join, written

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Second-level labels under a two-letter suffix that belong to the suffix. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is bad whose odds of good pages are under this share of the corpus's odds, and is blocked if that is so sure.
BAD_ODDS, SURE = 0.5, 0.9
#: Prior strengths (pseudo-observations) are fitted between these; the latter where no group has two labelled pages.
LEAST_STRENGTH, MOST_STRENGTH, USUAL_STRENGTH = 1.0, 1e6, 8.0
#: Cells of the quadrature of a posterior.
CELLS = 600


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there up to ? # or the end."""
    known = F.coalesce(url, F.lit("")).contains("://")
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, host).otherwise(""), F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like net/, and its verdict; null where none fits. Rules are code, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix by the label rule: two labels belong to the suffix after a second-level label."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    deep = (F.length(last) == 2) & second.isin(*SECOND_LEVEL) & (n >= 2)
    suffix = F.when(deep, F.concat_ws(".", second, last)).otherwise(last)
    domain = F.when(deep & (n >= 3), F.concat_ws(".", F.try_element_at(labels, F.lit(-3)), second, last)).when(~deep & (n >= 2), F.concat_ws(".", second, last)).otherwise(F.array_join(labels, "."))
    return domain, suffix


def shrunk(good: Column, seen: Column, prior: Column, strength: float) -> Column:
    """Mean of the beta posterior whose prior has this mean and so many pseudo-observations."""
    return (good + F.lit(strength) * prior) / (seen + F.lit(strength))


def fitted_strength(groups: DataFrame, good: str, seen: str, prior: str) -> float:
    """Prior strength of a level by the method of moments over all its groups.

    Under a beta-binomial with prior mean m and strength s the squared residual of a group with n outcomes has the mean
    n m (1 - m) (1 + (n - 1) / (s + 1)): what the groups spread beyond chance gives s. No spread gives the largest strength.
    """
    n, m = F.col(seen), F.col(prior)
    chance = n * m * (1 - m)
    r = groups.agg(F.sum((F.col(good) - n * m) ** 2).alias("spread"), F.sum(chance).alias("chance"), F.sum(chance * (n - 1)).alias("pairs")).first()
    if not r["pairs"] or r["pairs"] <= 0:
        return USUAL_STRENGTH
    rho = (r["spread"] - r["chance"]) / r["pairs"]
    return MOST_STRENGTH if rho <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / rho - 1)


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def chance_below(a: Column, b: Column, limit: Column) -> Column:
    """Probability that a beta(a, b) variable is under limit: midpoint quadrature over the log odds, where the density has
    no poles. Cells reach 12 deviations and the exponential tails; the cell that holds the limit counts in part."""

    def soft(z: Column) -> Column:
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

    def over(g: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            left = g["low"] + g["h"] * k
            z = left + g["h"] / 2
            f = F.exp(a * (z - g["mid"]) - (a + b) * (soft(z) - soft(g["mid"])))
            part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (g["cut"] - left) / g["h"]))
            return F.struct((acc["under"] + f * part).alias("under"), (acc["all"] + f).alias("all"))

        zero = F.struct(F.lit(0.0).alias("under"), F.lit(0.0).alias("all"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), zero, step, lambda acc: acc["under"] / acc["all"])

    mid, wide = F.log(a / b), 12 * F.sqrt(1 / a + 1 / b)
    low, high = mid - wide - 8 / a, mid + wide + 8 / b
    return let(F.struct(mid.alias("mid"), low.alias("low"), ((high - low) / CELLS).alias("h"), F.log(limit / (1 - limit)).alias("cut")), over)


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_odds: float = BAD_ODDS) -> DataFrame:
    """(host, n_seen, n_good, prior, strength, mean, limit, bad) for each host of pages.

    outcomes is (id_col, good 0/1): the labelled pages; a null outcome is none. Counts of all labelled pages roll up from
    host to registered domain to suffix to all. Each level's groups are shrunk to the mean of the other groups above them,
    by a strength that is fitted to how much the groups of the level differ. bad is the posterior probability that the host's
    share of good pages is under limit, where the odds are bad_odds of the odds over all labelled pages.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_and_path(F.col(url_col))[0].alias("host"))
    labels = outcomes.select(F.col(id_col).alias("id"), F.col("good").cast("double").alias("good")).where("id is not null and good is not null")
    labels = labels.groupBy("id").agg(F.avg("good").alias("good"))
    seen = rows.join(labels, "id", "left").groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = written(seen.select("host", "n", "g", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("g").alias("dg")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg")), "suffixes")
    top = suffixes.agg(F.sum("sn").alias("n"), F.sum("sg").alias("g")).first()
    n, g = top["n"] or 0.0, top["g"] or 0.0
    every = (g + 0.5) / (n + 1)
    # a prior leaves out the group's own outcomes, which would count twice
    s = suffixes.withColumn("s_prior", (g - F.col("sg") + 0.5) / (n - F.col("sn") + 1))
    k = fitted_strength(s, "sg", "sn", "s_prior")
    d = skew_join(domains, written(s, "suffix-priors"), "suffix").withColumn("d_prior", shrunk(F.col("sg") - F.col("dg"), F.col("sn") - F.col("dn"), F.col("s_prior"), k))
    d = written(d.select("domain", "dn", "dg", "d_prior"), "domain-priors")
    k = fitted_strength(d, "dg", "dn", "d_prior")
    h = skew_join(hosts, d, "domain").withColumn("prior", shrunk(F.col("dg") - F.col("g"), F.col("dn") - F.col("n"), F.col("d_prior"), k))
    h = written(h.select("host", "n", "g", "prior"), "host-priors")
    strength = fitted_strength(h, "g", "n", "prior")
    odds = bad_odds * every / (1 - every)
    limit = F.lit(odds / (1 + odds))
    a, b = F.col("g") + strength * F.col("prior"), F.col("n") - F.col("g") + strength * (1 - F.col("prior"))
    return h.select("host", F.col("n").cast("long").alias("n_seen"), F.col("g").alias("n_good"), "prior", F.lit(strength).alias("strength"), (a / (a + b)).alias("mean"), limit.alias("limit"), chance_below(a, b, limit).alias("bad"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sure: float = SURE, id_col: str = "page_id", url_col: str = "url", bad_odds: float = BAD_ODDS) -> DataFrame:
    """One row per row of pages: (id_col, host, path, rule, verdict, bad).

    The longest rule that fits decides; else a host is blocked if the posterior says with probability sure that its share
    of good pages is under the limit, that is, if the upper bound of the share is under it. Other hosts are allowed; those
    without labels are judged by the levels above. A null url, or one without ://, has an empty host and path and is judged
    like any other host. Repeated rows each get their row. Other columns play no part.
    """
    host, path = host_and_path(F.col(url_col))
    rows = written(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    reputation = written(host_reputation(pages, outcomes, id_col, url_col, bad_odds).select("host", "bad"), "reputation")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad") >= sure, "block").otherwise("allow")
    out = skew_join(rows, reputation, "host")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("bad"))


def allowed_pages(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """pages whose verdict is allow, with their columns as they are."""
    (gone,) = fresh(pages, "_blocked")
    blocked = url_verdicts(pages, outcomes, id_col=id_col, url_col=url_col, **how).where(F.col("verdict") == "block").select(F.col(id_col).alias(gone)).distinct()
    return pages.join(blocked, pages[id_col] == F.col(gone), "left_anti")
