"""URLs, hosts and identities as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules
from marram.functions.text import let, text

#: scheme, user information, host, port, path, query of an http(s) URL.
PARTS = r"(?is)^(https?)://(?:([^/?#]*)@)?(\[[0-9a-f:.%]*\]|[^/?#:@\[\]]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    """Host in lower case; empty if there is none."""
    return F.lower(_part(F.trim(text(url)), 3))


def domain(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(_part(F.trim(text(url)), 5), F.lit("")), F.lit("/"))


def _canonical(url: Column, strict: bool, none: Column) -> Column:
    u = F.trim(text(url))
    h = F.regexp_replace(F.lower(_part(u, 3)), r"\.+$", "")
    scheme, port = F.lower(_part(u, 1)), F.try_to_number(F.nullif(_part(u, 4), F.lit("")), F.lit("99999999")).cast("long")
    usual = F.coalesce(((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)), F.lit(True))
    shown = F.when(usual | (~F.lit(strict) & (F.coalesce(port, F.lit(0)) == 0)), h).otherwise(F.concat(h, F.lit(":"), port.cast("string")))
    good = u.rlike(PARTS) & (h != "") & (F.coalesce(port, F.lit(0)) <= 65535)
    if strict:
        good = good & (F.length(u) <= 8192) & ((_part(u, 2) == "") | (_part(u, 2) == ":"))
    q = F.when(_part(u, 6) == "?", "").otherwise(_part(u, 6))
    return F.when(good, F.concat(scheme, F.lit("://"), shown, F.coalesce(F.nullif(_part(u, 5), F.lit("")), F.lit("/")), q)).otherwise(none)


def canonical_url(url: Column) -> Column:
    """Canonical form of an http(s) URL, or null: no credentials, default port, fragment or trailing dot. ASCII hosts only."""
    return F.when(host(url).rlike(r"^[\x00-\x7f]*$"), _canonical(url, True, F.lit(None).cast("string")))


def citation_url(url: Column) -> Column:
    """Canonical form for citations: credentials are left out, and what isn't a URL is empty."""
    return _canonical(url, False, F.lit(""))


def evidence_id(url: Column) -> Column:
    return let(citation_url(url), lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("ev-"), F.substring(F.sha2(c, 256), 1, 16))))


def root_domain(name: Column) -> Column:
    """Last two labels; three under a two-letter suffix with a second level of its own."""
    labels = F.filter(F.split(F.regexp_replace(text(name), r"\.+$", ""), r"\."), lambda x: x != "")

    def of(p: Column) -> Column:
        deep = (F.size(p) >= 3) & (F.length(F.try_element_at(p, F.lit(-1))) == 2) & F.try_element_at(p, F.lit(-2)).isin(*rules.SECOND_LEVEL)
        last = lambda n: F.array_join(F.slice(p, -n, n), ".")
        return F.when(F.size(p) < 2, text(name)).when(deep, last(3)).otherwise(last(2))

    return let(labels, of)


def root_domain_naive(name: Column) -> Column:
    """Always the last two labels; a port stays."""
    return F.substring_index(F.lower(text(name)), ".", -2)


def in_domains(name: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Whether a domain is one of these or under one."""
    out = name.isin(*names)
    for n in names:
        out = out | name.endswith("." + n)
    return out


def sensitive_key(key: Column) -> Column:
    """Whether a query key names a credential."""
    low = F.replace(F.lower(text(key)), F.lit("-"), F.lit("_"))
    compact = F.regexp_replace(F.lower(text(key)), "[^a-z0-9]", "")
    plain = sorted({k.replace("_", "") for k in rules.SENSITIVE_KEYS})
    out = low.isin(*rules.SENSITIVE_KEYS) | compact.isin(*plain) | low.startswith("session_") | compact.startswith("session")
    for end in rules.SENSITIVE_ENDS:
        out = out | low.endswith(end)
    for end in rules.SENSITIVE_COMPACT_ENDS:
        out = out | compact.endswith(end)
    return out


def extract_urls(query: Column) -> Column:
    """Distinct canonical URLs in a text, without marks and unbalanced brackets at their ends."""
    found = F.regexp_extract_all(text(query), F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0))

    def bare(u: Column) -> Column:
        out = F.regexp_replace(u, r"[.,;:!?]+$", "")
        for left, right in ("()", "[]", "{}"):
            count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
            out = _balanced(out, left, right, count)
        return out

    return F.array_distinct(F.array_compact(F.transform(found, lambda u: canonical_url(bare(u)))))


def _balanced(u: Column, left: str, right: str, count) -> Column:
    def cut(x: Column) -> Column:
        tail = F.length(x) - F.length(F.rtrim(x, F.lit(right)))
        extra = F.greatest(F.lit(0), F.least(tail, count(x, right) - count(x, left)))
        return F.substring(x, F.lit(1), F.length(x) - extra)

    return let(u, cut)
