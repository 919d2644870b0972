"""Redaction of secrets and private identifiers by chained native replacements, counted before each.

A pattern is tried on texts that hold what each of its matches must have: plain substrings and short classes, which take a
fraction of the pattern's time. The only Python is on texts with something like an IPv6 address or a URL.
"""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram import rules
from marram.functions.text import text
from marram.operators.policy import without_credentials

# --- fixed values: patterns with validation in code ---
URL_IN_TEXT = r"https?://[^\s<>\]\[(){}\"']+"
BRACKETED_IPV6 = r"(?<![\w:])\[(?P<address>[0-9A-Fa-f:.]+(?:%[A-Za-z0-9_.-]+)?)\](?::\d{1,5})?(?:/[^\s<>\"']*)?(?![\w:])"
BARE_IPV6 = r"(?<![\w:])(?P<address>(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{2,}(?:%[A-Za-z0-9_.-]+)?)(?:/[^\s<>\"']*)?(?![\w:])"

_WORDS = ("password", "passwd", "secret", "token", "api", "access", "session", "sid", "sig")
#: For each pattern, in order: its matches hold one of each of these groups of substrings, in lower case.
NEEDS = {
    "SECRETS": (
        (("private key-----",),), (_WORDS, ("=", ":")), (_WORDS, (":",), ("\"", "'")), (_WORDS, ("=",), ("?", "&")), (("api-key",), (":",)), (("bearer",),), (("basic",),),
        (("akia",),), (("ghp_", "gho_", "ghu_", "ghs_", "github_pat_"),), (("aiza",),), (("sk-", "xox", "npm_", "pypi-"),), (("eyj",), (".",)), (("://",), ("@",)),
    ),
    "IDENTIFIERS": (
        (("-",),), ((".",),), (), (), (("@",), (".",)), (("localhost", ".internal", ".corp", ".home", ".lan", ".local", "home.arpa"),),
        (("internal", "private", "confidential"),), (("codename", "customer", "client", "tenant", "account", "ticket", "incident", "case"),), (("/", ":\\"),), (("-",),),
    ),
    "INLINE": ((_WORDS, ("=", ":")),),
}
#: And a short pattern, where substrings are too common.
CLASSES = {"SECRETS": {}, "IDENTIFIERS": {0: r"\p{Nd}-\p{Nd}{2}-", 1: r"\p{Nd}\.\p{Nd}", 2: r"\p{Nd}", 3: r"\p{Nd}[ .-]\p{Nd}{3}", 9: r"[A-Fa-f0-9]-[A-Fa-f0-9]{4}-"}, "INLINE": {}}
INLINE = ((rules.INLINE_SECRET, "$1[REDACTED]"),)


def folded(value: Column) -> Column:
    """Lower case, with the letters that match s and i without case as these."""
    for other, plain in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):
        value = F.replace(value if other != "ſ" else F.lower(value), F.lit(other), F.lit(plain))
    return value


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a column that a plan repeats would double with each pattern."""
    return F.transform(F.array(value), use)[0]


def _may(value: Column, low: Column, kind: str, i: int) -> Column:
    """Whether a text holds what each match of the pattern holds."""
    out = F.lit(True)
    for group in NEEDS[kind][i]:
        has = F.lit(False)
        for part in group:
            has = has | F.contains(low, F.lit(part))
        out = out & has
    return out & value.rlike(CLASSES[kind][i]) if i in CLASSES[kind] else out


def _chain(df: DataFrame, column: str, count: str, kind: str, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """The patterns one after another. What an earlier one leaves has no substring that its text hadn't, but for what it put there."""

    def step(state: Column, low: Column, i: int) -> Column:
        pattern, instead = "(?U)" + patterns[i][0], patterns[i][1]

        def counted(s: Column, t: Column) -> Column:
            return F.struct(t.alias("t"), (s["n"] + F.when(t != s["t"], F.regexp_count(s["t"], F.lit(pattern))).otherwise(0)).alias("n"))

        return let(state, lambda s: let(F.when(_may(s["t"], low, kind, i), F.regexp_replace(s["t"], pattern, instead)).otherwise(s["t"]), lambda t: counted(s, t)))

    def whole(low: Column) -> Column:
        state = F.struct(F.col(column).alias("t"), F.col(count).alias("n"))
        for i in range(len(patterns)):
            state = step(state, low, i)
        return state

    # a generator computes the state once, where a projection would be merged into each column that reads it
    df = df.select("*", F.inline(F.array(let(folded(F.col(column)), whole))).alias("_t", "_n"))
    return df.withColumn(column, F.col("_t")).withColumn(count, F.col("_n")).drop("_t", "_n")


def redact_secrets(df: DataFrame, column: Column, into: str = "redacted", count: str = "n_redactions") -> DataFrame:
    """df with the text, where credentials are replaced, and how many were. A null text is empty."""
    return _chain(df.withColumn(into, text(column)).withColumn(count, F.lit(0)), into, count, "SECRETS", rules.SECRETS)


def _without_ipv6(values: pd.Series) -> pd.DataFrame:
    def clean(value: str) -> tuple[str, int]:
        n = 0

        def one(m: re.Match) -> str:
            nonlocal n
            try:
                found = ipaddress.ip_address(m["address"].split("%", 1)[0]).version == 6
            except ValueError:
                found = False
            n += found
            return "[REDACTED_ADDRESS]" if found else m[0]

        return re.sub(BARE_IPV6, one, re.sub(BRACKETED_IPV6, one, value)), n

    rows = [clean(v) if v is not None and v.count(":") > 1 else (v, 0) for v in values]
    return pd.DataFrame(rows, columns=["text", "n"])


def _without_url_credentials(values: pd.Series) -> pd.DataFrame:
    def clean(value: str) -> tuple[str, int]:
        n = 0

        def one(m: re.Match) -> str:
            nonlocal n
            url, k = without_credentials(m[0])
            n += k
            return url

        return re.sub(URL_IN_TEXT, one, value, flags=re.I), n

    rows = [clean(v) if v is not None and "://" in v else (v, 0) for v in values]
    return pd.DataFrame(rows, columns=["text", "n"])


def _by(run, df: DataFrame, into: str, count: str, needed: Column) -> DataFrame:
    """run over the texts that need it; others are sent to it as null."""
    found = F.pandas_udf(run, "struct<text:string,n:int>")(F.when(needed, F.col(into)))
    df = df.select("*", found.alias("_found"))
    return df.withColumn(count, F.col(count) + F.coalesce("_found.n", F.lit(0))).withColumn(into, F.coalesce("_found.text", into)).drop("_found")


def redact_private(df: DataFrame, column: Column, into: str = "redacted", count: str = "n_redactions") -> DataFrame:
    """Secrets, then private identifiers, then inline assignments, then IPv6 addresses that are valid."""
    df = _chain(redact_secrets(df, column, into, count), into, count, "IDENTIFIERS", rules.IDENTIFIERS)
    df = _chain(df, into, count, "INLINE", INLINE)
    return _by(_without_ipv6, df, into, count, F.col(into).rlike(r"[0-9A-Fa-f:]:[0-9A-Fa-f]*:|\[[0-9A-Fa-f:.]*:"))


def redact_model_input(df: DataFrame, column: Column, into: str = "redacted", count: str = "n_redactions") -> DataFrame:
    """redact_private after credentials in URLs, and inline assignments once more after it."""
    df = df.withColumn(into, text(column)).withColumn(count, F.lit(0))
    df = _by(_without_url_credentials, df, into, count, F.contains(F.col(into), F.lit("://")))
    df = df.withColumnRenamed(count, "_urls")
    df = redact_private(df, F.col(into), into, count)
    df = _chain(df, into, count, "INLINE", INLINE)
    return df.withColumn(count, F.col(count) + F.col("_urls")).drop("_urls")
