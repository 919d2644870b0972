"""Scoring and choice of captured network responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram import rules
from marram.functions import urls
from marram.functions.text import contains_any, text

NETLOC = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)"


def path_query(url: Column) -> Column:
    rest = F.regexp_replace(text(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.lower(F.concat(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit("?"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)))


def noisy(url: Column) -> Column:
    return F.lower(text(url)).rlike("(?i)" + rules.STATIC_URL) | contains_any(F.lower(text(url)), rules.HARD_NOISE)


def soft_noisy(url: Column) -> Column:
    return contains_any(F.lower(text(url)), rules.SOFT_NOISE)


def data_endpoint(url: Column) -> Column:
    p = path_query(url)
    return p.rlike(rules.DATA_FILE) | F.arrays_overlap(F.regexp_extract_all(p, F.lit("[a-z0-9]{2,}"), F.lit(0)), F.array(*map(F.lit, rules.DATA_SEGMENTS)))


def scriptlike(body: Column) -> Column:
    sample = F.substring(F.ltrim(text(body)), 1, 4000)
    return contains_any(F.lower(sample), rules.SCRIPT_MARKERS) & (F.length(sample) - F.length(F.replace(sample, F.lit(";"), F.lit(""))) >= 8)


def relevance_terms(task: Column, labels: Column) -> Column:
    listed = F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) <= 12, F.array_join(labels, " "))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", text(task), F.coalesce(listed, F.lit("")))), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*rules.NETWORK_STOP))), 1, 25)


def network_scores(responses: DataFrame, terms: Column, start_domain: Column) -> DataFrame:
    """responses (url, status, content_type, text) with score, term_hits, data_endpoint and same_site."""
    kind, low = F.lower(text(F.col("content_type"))), F.lower(text(F.col("text")))
    rows = responses.withColumn("same_site", urls.root_domain_naive(F.lower(F.regexp_extract(text(F.col("url")), NETLOC, 1))) == urls.root_domain_naive(start_domain))
    rows = rows.withColumn("data_endpoint", data_endpoint(F.col("url"))).withColumn("term_hits", F.size(F.filter(terms, lambda t: low.contains(t) | F.lower(text(F.col("url"))).contains(t))))
    by_kind = F.when(kind.contains("json") | kind.contains("graphql"), 4).when(kind.contains("xml"), 3).when(kind.contains("text/plain"), 1).otherwise(0)
    hits = F.col("term_hits")
    noise = F.when(noisy(F.col("url")) | scriptlike(F.col("text")), -20).when(soft_noisy(F.col("url")) & (hits == 0), -8).otherwise(0)
    short = F.when((F.length(F.trim(text(F.col("text")))) < 80) & (hits == 0), -2).otherwise(0)
    score = F.col("status").between(200, 299).cast("int") + by_kind + F.col("same_site").cast("int") * 2 + F.col("data_endpoint").cast("int") * 3 + F.least(hits, F.lit(5)) * 2 + short + noise
    return rows.withColumn("score", F.coalesce(score, F.lit(0)).cast("int"))


def select_network(scored: DataFrame, ix: str = "ix", k: int = rules.MAX_NETWORK) -> DataFrame:
    """The first sighting of each URL, filtered by score, site and endpoint; the k best."""
    first = scored.where(text(F.col("url")) != "").withColumn("_rn", F.row_number().over(Window.partitionBy("url").orderBy(ix))).where("_rn = 1").drop("_rn")
    good = first.where((F.col("score") >= rules.LEAST_NETWORK_SCORE) & (F.col("same_site") | (F.col("term_hits") > 0)) & (F.col("data_endpoint") | (F.col("term_hits") > 0)))
    return good.orderBy(F.desc("score"), ix).limit(k)


# --- fixed values: what is worth capturing ---
BODY_LIMIT = 1_000_000
STATIC_RESOURCES = ("script", "stylesheet", "image", "media", "font", "manifest")
DATA_RESOURCES = ("xhr", "fetch")
STATIC_TYPES = ("javascript", "ecmascript", "text/css", "font/", "image/", "video/", "audio/", "mpegurl", "dash+xml", "octet-stream")


def should_capture(url: Column, content_type: Column, resource_type: Column, start_domain: Column) -> Column:
    """Whether a response is a data channel: JSON, XML or, on the same site's data endpoints, plain text."""
    kind, resource = F.lower(text(content_type)), F.lower(text(resource_type))
    machine = kind.contains("json") | kind.contains("graphql") | kind.contains("xml")
    same = urls.root_domain_naive(F.lower(F.regexp_extract(text(url), NETLOC, 1))) == urls.root_domain_naive(start_domain)
    fits = F.when(same, data_endpoint(url) | machine).otherwise(data_endpoint(url) & machine)
    out = resource.isin(*STATIC_RESOURCES) | noisy(url) | contains_any(kind, STATIC_TYPES) | kind.contains("text/html") | ~resource.isin("", *DATA_RESOURCES)
    return ~out & (machine | kind.contains("text/plain")) & fits


def bounded_length(content_encoding: Column, content_length: Column, limit: int = BODY_LIMIT) -> Column:
    """The declared length of a body that isn't compressed, from 1 to the limit; else null."""
    n = F.trim(text(content_length)).try_cast("long")
    return F.when(F.lower(F.trim(text(content_encoding))).isin("", "identity") & n.between(1, limit), n)


def decoded_body(body: Column, is_base64: Column, declared: Column, transferred: Column, limit: int = BODY_LIMIT) -> Column:
    """The text of a captured body whose transfer and size are within bounds; else null."""
    raw = F.when(is_base64, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(body, "UTF-8"))
    good = (transferred > 0) & (transferred <= limit) & (F.octet_length(raw) > 0) & (F.octet_length(raw) <= F.least(F.lit(limit), declared))
    return F.when(good, F.make_valid_utf8(raw.cast("string")))


def diagnostic_url(url: Column) -> Column:
    """Scheme and host with its port, for logs."""
    form = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?"
    scheme, host, port = (F.lower(F.regexp_extract(text(url), form, k)) for k in (1, 2, 3))
    bare = F.lower(F.regexp_extract(text(url), r"(?i)^([a-z][a-z0-9+.-]*):", 1))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown")))
