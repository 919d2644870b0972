"""Dates, freshness and version markers as native expressions. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram import rules
from marram.functions.text import has, let, squeeze, text


def parse_date(value: Column) -> Column:
    """A timestamp from ISO 8601, RFC 2822, epoch seconds or milliseconds, or a year-month-day in the text; else null."""
    t = squeeze(value)
    number = F.when(t.rlike(r"^\d{10,13}(?:\.\d+)?$"), t.try_cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"), F.regexp_replace(F.regexp_replace(t, "[zZ]$", "+00:00"), r"([T ]\d{2})$", "$1:00").try_cast("timestamp"))
    basic = F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd"))
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"(?i)\s(?:GMT|UTC|UT|Z)$", " +0000")
    rfc = F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), bare), F.lit("d MMM yyyy HH:mm:ss xx"))
    inside = rf"\b((?:19|20)\d{{2}})[-/](\d{{1,2}})[-/](\d{{1,2}})\b"
    ymd = F.concat_ws("-", *[F.lpad(F.regexp_extract(t, inside, k), n, "0") for k, n in ((1, 4), (2, 2), (3, 2))])
    found = F.when(t.rlike(inside), ymd.try_cast("timestamp"))
    return F.when((t != "") & (F.length(t) <= 200), F.when(number.isNotNull(), epoch).otherwise(F.coalesce(iso, basic, rfc, found)))


def show_date(at: Column) -> Column:
    """YYYY-MM-DD at midnight, else with seconds and Z."""
    midnight = at == F.date_trunc("day", at)
    return F.when(midnight, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def normalize_date(value: Column) -> Column:
    return let(parse_date(value), show_date)


def temporal_requirement(query: Column, time_range: Column | None = None) -> Column:
    high = has(query, "current_query")
    if time_range is not None:
        high = high | (text(time_range) != "")
    return F.when(high, "high").when(has(query, "version_sensitive"), "moderate").otherwise("none")


def freshness(at: Column, requirement: Column, as_of: Column) -> Column:
    """Score by age in days, halved unless the requirement is high; seconds are the finest unit."""
    days = (F.unix_micros(as_of) / 1e6 - F.floor(F.unix_micros(at) / 1e6)) / 86400
    score = F.when(days < -2, 0.0).when(days <= 7, 1.0).when(days <= 30, 0.9).when(days <= 90, 0.72).when(days <= 365, 0.48).when(days <= 1095, 0.2).otherwise(0.05)
    return F.when((requirement == "none") | at.isNull(), 0.0).otherwise(F.round(F.when(requirement == "high", score).otherwise(score * 0.5), 4))


def version_markers(*values: Column, limit: int = 8) -> Column:
    """Named product versions, then bare ones, distinct without case; year.month pairs aren't versions."""
    whole = F.concat_ws(" ", *[F.substring(text(v), 1, 20_000) for v in values])
    name = F.regexp_extract_all(whole, F.lit("(?iU)" + rules.NAMED_VERSION), F.lit(1))
    number = F.regexp_extract_all(whole, F.lit("(?iU)" + rules.NAMED_VERSION), F.lit(2))
    named = F.zip_with(name, number, lambda a, b: F.concat_ws(" ", a, b))
    bare = F.filter(F.regexp_extract_all(whole, F.lit("(?U)" + rules.VERSION), F.lit(1)), lambda v: ~v.rlike(r"^(?:19\d\d|20\d\d|2100)\.\d+$"))
    first = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    own = lambda n, v: let(first(n), lambda f: F.concat(f, F.filter(first(v), lambda x: ~F.exists(number, lambda y: F.lower(y) == F.lower(x)))))
    return F.slice(let(named, lambda n: let(bare, lambda v: own(n, v))), 1, limit)
