"""What fetching brings in: bytes to text, payloads of a crawler, outcomes for candidates, snapshots, and limits of egress."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marram import rules
from marram.functions import html
from marram.functions.text import text
from marram.operators.policy import address_faults

#: Charsets that Spark decodes itself, by the names that pages give them; any other is tried as UTF-8.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-32": "UTF-32"}
MARKDOWN = ("fit_markdown", "raw_markdown", "markdown_with_citations", "markdown")
FACTS = ("publishedDate", "publishedTime", "modifiedDate", "modifiedTime", "datePublished", "dateModified", "language", "author", "description", "softwareVersion")


def decode_body(body: Column, charset: Column) -> Column:
    """Bytes as text: by the charset that is given, else as UTF-8, else as UTF-8 with marks for what isn't.

    A body in another charset than its page says falls through as soon as a byte doesn't fit.
    """
    name = F.lower(F.trim(text(charset)))
    as_utf8 = F.try_validate_utf8(body.cast("string"))
    ascii_only = F.when(~body.cast("string").rlike(r"[^\x00-\x7F]"), as_utf8)
    wide = [F.when(name.isin(*[k for k, v in CHARSETS.items() if v == java]), F.decode(body, java)) for java in ("ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")]
    told = F.coalesce(F.when(name.isin("us-ascii", "ascii"), ascii_only), *wide)
    return F.coalesce(told, as_utf8, F.make_valid_utf8(body.cast("string")))


def _text_at(payload: Column, *path: str) -> Column:
    """A string at a path of JSON, null if it is blank or not there."""
    found = F.get_json_object(payload, "$" + "".join(f".{p}" for p in path))
    return F.when(found.rlike(r"(?U)\S"), found)


def crawl_payload(payload: Column) -> Column:
    """The object of a crawler's answer: the first of results, or of a list, or the answer itself."""
    first = [F.get_json_object(payload, "$.results[0]"), F.when(F.regexp_like(payload, F.lit(r"^\s*\[")), F.get_json_object(payload, "$[0]"))]
    return F.when(F.get_json_object(payload, "$.results").rlike(r"^\["), F.coalesce(first[0], F.lit("{}"))).otherwise(F.coalesce(first[1], payload))


def crawl_markdown(payload: Column) -> Column:
    """The first of the markdown forms that isn't blank, or markdown itself where it is a string."""
    plain = _text_at(payload, "markdown")
    return F.coalesce(*[_text_at(payload, "markdown", k) for k in MARKDOWN], F.when(~plain.rlike(r"^\s*\{"), plain), F.lit(""))


def crawled_pages(rows: DataFrame, payload: str = "payload", url: str = "url") -> DataFrame:
    """rows with what a crawler's answer says: page_url, title, content, content_chars, status_code and facts, a map.

    Without markdown the cleaned HTML or the extracted content is read, as a page or as JSON.
    """
    p = F.col("_p")
    rows = rows.withColumn("_p", crawl_payload(F.col(payload))).withColumn("_mark", crawl_markdown(p))
    spare = F.coalesce(_text_at(p, "cleaned_html"), _text_at(p, "extracted_content"), F.lit(""))
    rows = rows.withColumn("_spare", F.when(F.col("_mark") == "", spare))
    is_html = F.col("_spare").rlike(r"^\s*<")
    as_page = html.read_page(F.when(is_html, F.col("_spare")), F.col(url))["text"]
    as_json = html.flatten_json(F.when(~is_html, F.col("_spare")))
    whole = F.when(F.col("_mark") != "", F.col("_mark")).when(is_html, as_page).otherwise(F.coalesce(as_json, F.lit("")))
    content = F.regexp_replace(F.substring(whole, 1, rules.PAGE_CHARS), r"(?U)^\s+|\s+$", "")
    facts = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k in FACTS for v in [F.coalesce(_text_at(p, k), _text_at(p, "metadata", k))]])))
    title = F.coalesce(_text_at(p, "title"), _text_at(p, "metadata", "title"))
    rows = rows.withColumn("page_url", F.coalesce(_text_at(p, "url"), F.col(url))).withColumn("title", title).withColumn("content", content)
    rows = rows.withColumn("content_chars", F.length("content")).withColumn("status_code", F.get_json_object(p, "$.status_code").cast("int")).withColumn("facts", facts)
    return rows.drop("_p", "_mark", "_spare")


def crawl_outcomes(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, url, ix, fetched, error) of each candidate: pages is (request_id, url, error); none is one that came too late."""
    done = pages.groupBy("request_id", "url").agg(F.min(F.coalesce("error", F.lit(""))).alias("_error"))
    out = candidates.join(done, ["request_id", "url"], "left")
    error = F.when(F.col("_error").isNull(), "deadline").otherwise(F.nullif(F.col("_error"), F.lit("")))
    return out.select("request_id", "url", "ix", error.isNull().alias("fetched"), error.alias("error"))


def distinct_snapshots(rows: DataFrame, per: list[str], ix: str = "ix", value: str = "text") -> DataFrame:
    """Snapshots in order without blank ones and those that equal the one before."""
    clean = rows.withColumn(value, F.regexp_replace(text(F.col(value)), r"(?U)^\s+|\s+$", "")).where(F.col(value) != "")
    return clean.withColumn("_last", F.lag(value).over(Window.partitionBy(*per).orderBy(ix))).where(~F.col(value).eqNullSafe(F.col("_last"))).drop("_last")


def merged_text(parts: Column, responses: Column) -> Column:
    """Text of a page's parts, then of its network responses (url, text), blank lines between, three line feeds at most."""
    told = F.transform(F.filter(responses, lambda r: text(r["text"]) != ""), lambda r: F.concat(F.lit("Network response: "), r["url"], F.lit("\n"), F.substring(r["text"], 1, NETWORK_CHARS)))
    pieces = F.filter(F.array(F.array_join(parts, "\n\n"), F.array_join(told, "\n\n")), lambda x: x != "")
    return F.regexp_replace(F.regexp_replace(F.array_join(pieces, "\n\n"), r"\n{4,}", "\n\n\n"), r"(?U)^\s+|\s+$", "")


# --- fixed value: characters of a network response ---
NETWORK_CHARS = 4_000


def parse_ports(value: str) -> tuple[int, ...]:
    """Ports of a comma-separated list, for url_policy."""
    items = [x.strip() for x in value.split(",") if x.strip()]
    if not 1 <= len(items) <= rules.MAX_PORTS or not all(x.isascii() and x.isdigit() and 1 <= int(x) <= 65535 for x in items):
        raise ValueError(f"not 1 to {rules.MAX_PORTS} ports from 1 to 65535: {value}")
    return tuple(sorted(set(map(int, items))))


def parse_networks(value: str) -> tuple[str, ...]:
    """Networks of a comma-separated list, for url_policy and dns_answers; host bits are cleared."""
    items = [x.strip() for x in value.split(",") if x.strip()]
    if len(items) > rules.MAX_NETWORKS:
        raise ValueError(f"more than {rules.MAX_NETWORKS} networks")
    return tuple(str(ipaddress.ip_network(x, strict=False)) for x in items)


def dns_answers(addresses: Column, denied: tuple[str, ...] = ()) -> Column:
    """Struct of the distinct addresses in order, IPv4 first, and the first fault: all must be public, and there must be one."""
    judged = address_faults(addresses, denied)
    faults = F.filter(judged, lambda x: x["fault"].isNotNull())
    order = F.array_sort(F.array_distinct(F.transform(judged, lambda x: F.struct(x["version"].alias("version"), x["number"].alias("number"), x["address"].alias("address")))))
    fault = F.when(F.coalesce(F.size(judged), F.lit(0)) <= 0, F.lit("no addresses")).otherwise(F.get(faults, 0)["fault"])
    none = F.array().cast("array<string>")
    return F.struct(F.when(fault.isNull(), F.transform(order, lambda x: x["address"])).otherwise(none).alias("addresses"), fault.alias("fault"))

