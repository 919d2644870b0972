"""The registered queries of the retrieval operators, and their SQL.

Driver tables stand in for retrieved data: pages are hits and fetched pages, conversations hold query texts, benchmark
passages are longer queries, events give dates, latencies and cache ages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram import rules
from marram.functions import dates, html, intent, sources, text, urls
from marram.operators import assembly, crawl, discovery, evaluation, lines, links, network, pages, policy, ranking, redact, sections, summary, tasks
from marram.sources import tables
from marram.plans.oracles import ORACLES
from marram.plans.oracles_more import MORE

#: The query of the rankings: words of the synthetic corpus.
QUERY = "restes onnd thingha erand ofther nterthing"
AS_OF = "2024-06-30 00:00:00"
#: Domains with a weight of their own, in the order of the alphabet.
ADJUSTED = sorted(rules.DOMAIN_BOOSTS | rules.DOMAIN_PENALTIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def canonical_url(spark, d):
    return _urls(spark, d).select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


def citation_url(spark, d):
    return _urls(spark, d).select("page_id", urls.citation_url(F.col("url")).alias("citation_url"))


def evidence_id(spark, d):
    return _urls(spark, d).select("page_id", urls.evidence_id(F.col("url")).alias("evidence_id"))


def domain(spark, d):
    return _urls(spark, d).select("page_id", urls.domain(F.col("url")).alias("domain"))


def root_domain(spark, d):
    return _urls(spark, d).select("page_id", urls.root_domain(urls.domain(F.col("url"))).alias("root_domain"))


def sensitive_key(spark, d):
    """All keys of the URLs, and one more of each: of credentials and of none, with marks and in capitals."""
    names = F.array(*map(F.lit, ["Access-Token", "X-Amz-Signature", "session_key", "sessionABC", "my.password", "page", "monkey", "PHPSESSID", "client_secret2", "Sig"]))
    more = F.concat("url", F.lit("&"), F.element_at(names, (F.col("page_id") % 10 + 1).cast("int")), F.lit("=1"))
    rows = _urls(spark, d).select("page_id", F.posexplode(F.regexp_extract_all(more, F.lit(r"[?&]([^=&#]+)="), F.lit(1))).alias("ix", "key"))
    return rows.select("page_id", "ix", "key", urls.sensitive_key(F.col("key")).alias("is_sensitive"))


def extract_urls(spark, d):
    rows = _urls(spark, d).select("page_id", F.concat(F.lit("see ("), F.col("url"), F.lit("), and "), F.col("url"), F.lit(".")).alias("q"))
    return rows.select("page_id", F.array_join(urls.extract_urls(F.col("q")), " ").alias("urls"))


def source_adjustment(spark, d):
    """Domains of pages, of each weighted domain, under each, and only alike."""
    known = F.array(*map(F.lit, ADJUSTED))
    name = F.element_at(known, (F.col("page_id") % len(ADJUSTED) + 1).cast("int"))
    kind = F.floor(F.col("page_id") / len(ADJUSTED)) % 4
    at = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("docs."), name)).when(kind == 2, F.concat(F.lit("not"), name)).otherwise(urls.domain(F.col("url")))
    return _urls(spark, d).select("page_id", F.round(sources.source_adjustment(at), 4).alias("source_adjustment"))


def source_profile(spark, d):
    p = sources.source_profile(F.col("url"), F.lit(""), F.lit("example documentation"))
    return _urls(spark, d).select("page_id", p.alias("p")).select("page_id", "p.*")


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def lexical_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.lexical_score(F.lit(QUERY), F.col("text")), 6).alias("lexical_score"))


def lexical_rerank(spark, d):
    out = ranking.lexical_rerank(table(spark, d, "documents"), QUERY, 20)
    return out.select("doc_id", "position", F.round("rerank_score", 6).alias("rerank_score"), F.round("ranking_score", 6).alias("ranking_score"))


def subject_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.subject_coverage(F.lit(QUERY), F.col("text")), 6).alias("subject_coverage"))


def _queries(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))


def mode_for(spark, d):
    return _queries(spark, d).select("conv_id", "turn", intent.mode_for(F.col("query"), F.lit("auto")).alias("mode"))


def temporal_requirement(spark, d):
    return _queries(spark, d).select("conv_id", "turn", dates.temporal_requirement(F.col("query")).alias("temporal_requirement"))


def categories(spark, d):
    return _queries(spark, d).select("conv_id", "turn", F.array_join(intent.search_categories(F.col("query")), ",").alias("categories"))


def engines(spark, d):
    return _queries(spark, d).select("conv_id", "turn", F.array_join(intent.search_engines(F.col("query"), intent.search_categories(F.col("query")), F.col("query")), ",").alias("engines"))


def query_variants(spark, d):
    return _queries(spark, d).select("conv_id", "turn", F.posexplode(intent.query_variants(F.col("query"), F.lit("deep"))).alias("variant_ix", "variant"))


def normalize_date(spark, d):
    """Stamps of events in each form: ISO with and without an offset, a date, RFC 2822, epoch seconds and milliseconds, a date in
    a text, figures alone, and none."""
    at = F.date_trunc("second", F.col("ts"))
    forms = [
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.date_format(at, "yyyy-MM-dd"),
        F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'"), F.unix_seconds(at).cast("string"), F.unix_millis(at).cast("string"),
        F.concat(F.lit("posted "), F.date_format(at, "yyyy/M/d"), F.lit(" by someone")), F.date_format(at, "yyyyMMdd"), F.concat(F.lit("no date "), F.col("event_id").cast("string")), F.lit(" "),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", dates.normalize_date(raw).alias("normalized"))


def freshness(spark, d):
    score = dates.freshness(F.date_trunc("second", F.col("ts")), F.when(F.col("user_id") % 2 == 0, "high").otherwise("moderate"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, d, "events").select("event_id", score.alias("freshness"))


def version_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(dates.version_markers(F.col("text")), " ").alias("versions"))


def normalize_heading(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    return rows.select("doc_id", "ix", text.normalize_heading(F.col("line")).alias("heading"))


def ranking_score(spark, d):
    return table(spark, d, "events").select("event_id", F.round(text.ranking_score(F.lit(1.0), F.col("value") / 20), 6).alias("ranking_score"))


def body_format(spark, d):
    return table(spark, d, "pages").select("page_id", pages.body_format(F.col("html"), F.lit("text/plain; charset=utf-8")).alias("format"))


def usable_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", pages.usable(F.col("text")).alias("usable"))


def best_attempt(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("u"), F.floor(F.col("doc_id") / 3).cast("string")).alias("url"), (F.col("doc_id") % 3 + 1).cast("int").alias("tier"), F.col("text").alias("content"))
    return pages.best_attempt(rows).select("url", "tier", F.col("content_chars").cast("long").alias("content_chars"), "low_confidence")


def cache_state(spark, d):
    age = F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", pages.cache_state(F.pmod(age, F.lit(200_000))).alias("state"))


def chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(pages.chunks(F.col("text"))).alias("chunk_ix", "chunk"))


def redact_secrets(spark, d):
    return redact.redact_secrets(table(spark, d, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "redacted", "n_redactions")


def redact_pii(spark, d):
    return redact.redact_private(table(spark, d, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "redacted", "n_redactions")


def _hits(spark, d):
    """pages as hits of requests by page_id, scored by their url; the same url may come more than once."""
    rows = table(spark, d, "pages").select("page_id", "url", "html")
    return rows.select(
        F.col("page_id").alias("ix"), (F.col("page_id") % 7).alias("request_id"), urls.domain(F.col("url")).alias("domain"), "url",
        F.round((F.length("html") % 97) / 10.0, 2).alias("discovery_score"),
    )


def dedup_candidates(spark, d):
    return ranking.dedup_candidates(_hits(spark, d), ["request_id", "domain"]).select("request_id", "domain", "url", "ix", "discovery_score", "first_seen_ix")


def top_candidates(spark, d):
    return ranking.top_k(_hits(spark, d), [F.desc("discovery_score"), F.col("ix")], 30).select("ix", "discovery_score", "position")


def diversified(spark, d):
    rows = _hits(spark, d).withColumn("owner", urls.root_domain(F.col("domain")))
    return ranking.diversified(rows, ["request_id"], 8, score="discovery_score", ix="ix").select("request_id", "ix", "owner", "position")


def snippet_fallback(spark, d):
    hits = _hits(spark, d)
    results = hits.where("ix % 3 = 0").withColumn("position", F.col("ix"))
    return ranking.snippet_fallback(results, hits, ["request_id"], 40).select("request_id", "url", "is_fallback", "position")


def _passages(spark, d):
    """Lines of documents as passages of a page; scores from the query."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("passage_index", "text"))
    return rows.withColumn("lexical_score", text.lexical_score(F.lit(QUERY), F.col("text"))).withColumn("source_score", (F.col("doc_id") % 5).cast("double"))


def top_passages(spark, d):
    rows = ranking.top_passages(_passages(spark, d), ["doc_id"], score="lexical_score")
    return rows.select("doc_id", "passage_index", F.round("lexical_score", 6).alias("lexical_score"), "rank")


def page_content(spark, d):
    return ranking.page_content(_passages(spark, d), ["doc_id"], score="lexical_score").select("doc_id", "content", F.round("page_score", 6).alias("page_score"))


def prefilter_passages(spark, d):
    rows = _passages(spark, d).withColumn("ix", F.col("doc_id") * 100_000 + F.col("passage_index"))
    return ranking.prefilter_passages(rows).select("doc_id", "passage_index", "position")


def evidence_summary(spark, d):
    rows = _hits(spark, d).withColumn("position", F.col("ix"))
    none = F.lit(None).cast("string")
    results = rows.select("request_id", "position", "url", (F.col("ix") % 11 == 0).alias("primary_source_candidate"), F.when(F.col("ix") % 5 == 0, "2024-01-01").alias("published_at"), none.alias("modified_at"), none.alias("declared_at"), F.when(F.col("ix") % 4 != 0, "direct").alias("extraction_method"), urls.citation_url(F.col("url")).alias("citation_url"), F.lit(None).cast("array<string>").alias("version_context"))
    requests = rows.select("request_id").distinct().withColumn("query", F.lit("latest release of the package"))
    out = summary.evidence_summary(results, requests)
    return out.withColumn("version_contexts", F.array_join("version_contexts", ",")).withColumn("warnings", F.array_join("warnings", "|"))


def latency_summary(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("passed"), F.col("value").alias("latency"))
    return summary.latency_summary(rows, ["event_type"])


def network_score(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("ix"), F.concat("url", F.when(F.col("page_id") % 2 == 0, "/api/data.json").otherwise("")).alias("url"), F.lit(200).alias("status"), F.when(F.col("page_id") % 3 == 0, "application/json").otherwise("text/plain").alias("content_type"), F.col("html").alias("text"))
    terms = network.relevance_terms(F.lit("thing about example data"), F.array().cast("array<string>"))
    return network.network_scores(rows, terms, F.lit("www.example.com")).select("ix", "same_site", "data_endpoint", F.col("term_hits").cast("int").alias("term_hits"), "score")


def _read(spark, d):
    return table(spark, d, "pages").select("page_id", html.read_page(F.col("html"), F.col("url")).alias("p"))


def html_to_text(spark, d):
    return _read(spark, d).select("page_id", F.col("p.text").alias("text"))


def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title_element(F.col("html")).alias("title"))


def page_metadata(spark, d):
    """Pages whose heads declare facts: as properties, as names, in JSON for each third page, or not at all for each fifth."""
    n = F.col("page_id").cast("string")
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    names = F.concat(F.lit('<meta name="author" content="Author '), n, F.lit('"><meta property="og:description" content=" About  '), n, F.lit(' "><meta property="article:published_time" content="'), day, F.lit('T10:00:00Z"><meta name="last-modified" content="'), day, F.lit('">'))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "Article", "author": [{"name": "A'), n, F.lit('"}, {"name": "B"}], "datePublished": "'), day, F.lit('", "description": "LD"}</script>'))
    head = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 3 == 0, ld).otherwise(names)
    page = table(spark, d, "pages").select("page_id", html.read_page(F.concat(head, F.col("html")), F.col("url")).alias("p"))
    p = "p.declared."
    return page.select("page_id", F.col(p + "language").alias("language"), F.col(p + "author").alias("author"), F.col(p + "description").alias("description"), dates.normalize_date(F.col(p + "published")).alias("published_at"), dates.normalize_date(F.col(p + "modified")).alias("modified_at"))


def page_links(spark, d):
    return _read(spark, d).select("page_id", F.posexplode("p.links").alias("link_ix", "link")).select("page_id", "link_ix", "link.url", "link.anchor")


def flatten_props(spark, d):
    return table(spark, d, "events").select("event_id", html.flatten_json(F.col("props")).alias("flat"))


def normalized_hits(spark, d):
    """Pages as hits of three requests, with words of the corpus as queries."""
    names = ["the thing of restes", "latest thingha erand", "est de la que"]
    requests = spark.createDataFrame([(i, q, None) for i, q in enumerate(names)], "request_id long, query string, time_range string").withColumn("as_of", F.lit(AS_OF).cast("timestamp"))
    page = table(spark, d, "pages")
    none = F.lit(None).cast("string")
    hits = page.select((F.col("page_id") % 3).alias("request_id"), F.col("page_id").alias("ix"), (F.col("page_id") % 10 + 1).cast("int").alias("rank"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url", F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), " ").alias("content"), none.alias("published_raw"), none.alias("modified_raw"))
    out = discovery.discover(requests, hits)
    return out.withColumn("version_context", F.array_join("version_context", ","))


def url_policy(spark, d):
    return _urls(spark, d).select("page_id", policy.url_policy(F.concat("url", F.lit("&token=x"))).alias("fault"))


def redact_url(spark, d):
    u = F.concat(F.regexp_replace("url", "#.*", ""), F.lit("?token=abc&page=1"))
    return _urls(spark, d).select("page_id", policy.redact_url(u).alias("r")).select("page_id", "r.url", "r.n")


def follow_links(spark, d):
    page = table(spark, d, "pages").select((F.col("page_id") % 7).alias("request_id"), F.col("page_id").cast("int").alias("page_index"), "url", html.read_page(F.col("html"), F.col("url"))["links"].alias("links"))
    requests = spark.createDataFrame([(i, "thanedble attion ciónue erüver sch") for i in range(7)], "request_id long, query string")
    return links.follow_links(page, requests, 10)


def passages(spark, d):
    none = F.lit(None).cast("string")
    page = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("request_id"), F.col("doc_id").cast("int").alias("page_index"), F.col("text").alias("content"), F.col("source").alias("title"), none.alias("source_type"), none.alias("published_at"), none.alias("modified_at"), none.alias("declared_at"), F.lit(None).cast("array<string>").alias("version_context"), (F.col("doc_id") % 5).cast("double").alias("discovery_score"), F.lit(0.0).alias("source_authority"))
    requests = spark.createDataFrame([(i, QUERY) for i in range(7)], "request_id long, query string")
    return links.passages(page, requests).select("request_id", "page_index", "passage_index", F.round("lexical_score", 6).alias("lexical_score"), "position")


def distinct_lines(spark, d):
    return lines.line_rows(table(spark, d, "documents")).select("doc_id", "ix", "line")


def table_like_rows(spark, d):
    rows = lines.line_rows(table(spark, d, "documents"))
    return rows.where(lines.table_like(F.col("line"), lines.task_terms(F.lit(QUERY)))).select("doc_id", "ix", "line")


def confidence(spark, d):
    n = lambda m: F.col("event_id") % m
    return table(spark, d, "events").select("event_id", lines.confidence(n(2), n(3), n(40), n(5), n(1000)).alias("confidence"))


def searx_view(spark, d):
    rows = _hits(spark, d).select(F.col("request_id"), "url", F.col("domain").alias("title"), F.lit("").alias("snippet"), "discovery_score", F.lit(None).cast("string").alias("published_at"))
    return tables.searx_view(rows)


def evaluation_rows(spark, d):
    """Requests of hits as cases, latencies from events."""
    rows = _hits(spark, d).withColumn("id", F.col("request_id").cast("string"))
    results = rows.select("id", F.col("domain").alias("title"), F.lit("").alias("content"), "url", F.lit("general_web").alias("source_type"), F.col("url").alias("citation_url"), F.when(F.col("ix") % 4 != 0, "direct").alias("extraction_method"), F.when(F.col("ix") % 5 == 0, "2024-01-01").alias("published_at"), (F.col("ix") % 11 == 0).alias("primary_source_candidate"))
    cases = spark.createDataFrame([(str(i), 30 + i, ["example.org"] if i % 2 else None, ["tionsh"] if i % 3 else None, ["news"] if i == 6 else None) for i in [*range(7), -1]], "id string, min_results int, expected_domains array<string>, expected_any_terms array<string>, expected_source_types array<string>")
    runs = table(spark, d, "events").where(F.col("event_id").isNotNull()).select(F.col("event_id").cast("string").alias("id"), F.lit(200).alias("status_code"), F.col("value").alias("latency_seconds"))
    return evaluation.evaluate(cases, results, runs)


def relevant_lines(spark, d):
    return sections.relevant_lines(table(spark, d, "documents").select("doc_id", "text"), QUERY, ["Overview"])


def section_map(spark, d):
    rows = sections.with_sections(table(spark, d, "documents").select("doc_id", "text"), ["the", "Installation"], into="m")
    return rows.select("doc_id", F.explode("m").alias("header", "s")).select("doc_id", "header", "s.found", F.size("s.items").alias("n_items"))


def should_capture(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "application/json").when(F.col("page_id") % 3 == 1, "text/plain").otherwise("text/html")
    u = F.concat(F.regexp_replace("url", r"[?#].*", ""), F.when(F.col("page_id") % 2 == 0, "/api/data.json").otherwise(""))
    return _urls(spark, d).select("page_id", network.should_capture(u, kind, F.lit("xhr"), F.lit("www.example.com")).alias("captured"))


def direct_candidates(spark, d):
    rows = _urls(spark, d).select(F.col("page_id").alias("request_id"), F.concat(F.lit("read "), F.col("url")).alias("query"))
    out = discovery.direct_candidates(rows)
    return out.select("request_id", "url", "domain", "title", F.round("discovery_score", 4).alias("discovery_score"), "source_type", "evidence_id")


def _task(spark, d):
    """Texts of conversations as tasks, every fifth with words that name a kind of task."""
    more = F.array(*map(F.lit, ["install the docker compose plugin", "list all rows of the table", "oem cross reference of a filter", 'the \"Known Issues\" of this release', "price and security"]))
    picked = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0
    said = F.element_at(more, (F.pmod(F.col("conv_id") + 3 * F.col("turn"), F.lit(5)) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(picked, said).otherwise(F.col("text")).alias("task"))


def task_kind(spark, d):
    return _task(spark, d).select("conv_id", "turn", tasks.is_product(F.col("task")).alias("is_product"), tasks.is_documentation(F.col("task")).alias("is_documentation"))


def page_labels(spark, d):
    labels = tasks.page_labels(F.col("task"), product=tasks.is_product(F.col("task")))
    return _task(spark, d).select("conv_id", "turn", F.array_join(labels, "|").alias("labels"))


def extraction_sufficient(spark, d):
    n = lambda m: F.col("event_id") % m
    task = F.element_at(F.array(*map(F.lit, ["all rows of a table", "part number of a filter", "anything"])), (n(3) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", tasks.extraction_sufficient(task, F.when(n(11) == 0, 1).otherwise(0), n(29), n(13), n(2), n(5000)).alias("is_sufficient"))


def decode_body(spark, d):
    """Texts as bytes of several charsets, with right, wrong and unknown names, some cut within a character."""
    kind = F.pmod("doc_id", F.lit(5))
    body = F.when(kind == 1, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    body = F.when(kind == 3, F.concat(body, F.lit(bytes([0xC3])))).otherwise(body)
    charset = F.element_at(F.array(*map(F.lit, ["utf-8", "utf-16be", "x-unknown", "utf-8", "us-ascii"])), (kind + 1).cast("int"))
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", crawl.decode_body(body, charset).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def assembled_results(spark, d):
    """Documents as fetched pages under the URLs of pages, their lines as ranked passages, every page but each third found by search."""
    page = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    none = F.lit(None).cast("string")
    base = page.select((F.col("doc_id") % 7).alias("request_id"), F.col("doc_id").alias("page_index"), "url")
    fetched = base.select("*", F.when(F.col("page_index") % 4 != 0, F.concat(F.lit("Page "), F.col("page_index").cast("string"))).alias("title"), F.when(F.col("page_index") % 5 == 0, "2024-05-01").alias("published_at"), none.alias("modified_at"), none.alias("declared_at"), F.lit(None).cast("array<string>").alias("version_context"), F.lit("direct").alias("extraction_method"), F.lit(0).alias("content_chars"))
    found = base.groupBy("request_id", "url").agg(F.min("page_index").alias("ix")).where("ix % 3 <> 0")
    found = found.select("request_id", "url", F.concat(F.lit("Hit "), F.col("ix").cast("string")).alias("title"), F.lit("found").alias("snippet"), F.lit("2023-01-01").alias("published_at"), none.alias("modified_at"), none.alias("source_type"), F.lit(None).cast("int").alias("source_tier"), F.lit(None).cast("int").alias("authority_score"), F.lit(None).cast("boolean").alias("primary_source_candidate"), F.lit(0.5).alias("freshness_score"), F.lit(None).cast("array<string>").alias("version_context"), none.alias("evidence_id"), F.lit(None).cast("array<string>").alias("engines"))
    rows = table(spark, d, "documents").join(page, "doc_id").select((F.col("doc_id") % 7).alias("request_id"), F.col("doc_id").alias("page_index"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    passages = rows.select("request_id", "page_index", (F.col("page_index") * 100_000 + F.col("k")).alias("ix"), "text", F.when(F.col("k") % 6 != 5, (F.length("text") % 97) / 10.0).alias("ranking_score"), F.lit(0.25).alias("rerank_score"))
    requests = spark.createDataFrame([(i, QUERY) for i in range(7)], "request_id long, query string")
    out = assembly.assembled(requests, fetched, found, passages, 6)
    return out.select("request_id", "position", "page_index", "title", "url", "content", "snippet", "score", "published_at", "freshness_score", "citation_url")


def crawl_outcomes(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("request_id"), "url", F.col("page_id").alias("ix"))
    done = rows.where("ix % 3 <> 0").select("request_id", "url", F.when(F.col("ix") % 4 == 0, "TimeoutError").alias("error"))
    return crawl.crawl_outcomes(rows, done)


def distinct_snapshots(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("ix", "text"))
    return crawl.distinct_snapshots(rows, ["id"]).select(F.col("id").alias("doc_id"), "ix", F.sha2("text", 256).alias("text_sha256"))


def merged_text(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("parts"))
    reply = F.struct(F.lit("https://example.org/api").alias("url"), F.concat(F.get("parts", 0), F.lit("\n\n\n\n\nend ")).alias("text"))
    none = F.struct(F.lit("https://example.org/none").alias("url"), F.lit("").alias("text"))
    whole = crawl.merged_text(F.col("parts"), F.array(reply, none))
    return rows.select("doc_id", F.length(whole).cast("long").alias("n_chars"), F.sha2(whole, 256).alias("text_sha256"))


def rerank(spark, d):
    """Lines of documents as documents to rank; a model's scores for some of them, some not finite."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("request_id"), F.col("doc_id").alias("ix"), F.round(text.lexical_score(F.lit(QUERY), F.col("text")), 6).alias("lexical_score"), ((F.col("doc_id") % 9) - 4).cast("double").alias("rank_authority"))
    score = F.when(F.col("ix") % 10 == 0, float("nan")).otherwise((F.col("ix") % 101) / 10.0)
    scores = rows.where("ix % 3 = 0").select("request_id", "ix", score.alias("model_score"))
    out = ranking.rerank(rows, scores, ["request_id", "ix"], 20, per=["request_id"])
    return out.select("request_id", "ix", "position", "is_scored", F.round("ranking_score", 6).alias("ranking_score"))


def rerank_status(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 11).alias("request_id"), F.col("doc_id").alias("ix"))
    r = F.col("request_id")
    score = F.when(r == 3, float("nan")).when((r == 4) & (F.col("ix") % 2 == 0), float("inf")).when((r != 5) | (F.col("ix") % 3 != 0), 0.5)
    requests = spark.createDataFrame([(i, "deadline" if i == 6 else None) for i in range(12)], "request_id long, failure string")
    return ranking.rerank_status(requests, docs, docs.where("request_id <> 6").withColumn("model_score", score))


def cache_lookup(spark, d):
    """Events as requests and as entries of a cache: fresh, stale and expired results, and refreshes that failed."""
    at = F.lit(AS_OF).cast("timestamp")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 997).cast("string")).alias("cache_key"))
    cached = F.timestamp_seconds(F.unix_seconds(at) - (F.col("event_id") * 37) % 200_000)
    entries = rows.where("event_id % 2 = 0").select("cache_key", cached.alias("cached_at"), F.col("event_id").cast("string").alias("result"))
    cache = pages.put(entries.limit(0), entries)
    asked = rows.where("event_id % 5 = 0").withColumn("as_of", at)
    got = pages.lookup(asked, cache)
    fresh = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("new "), F.col("event_id").cast("string")))
    out = pages.refreshed(got, fresh, F.when(F.col("event_id") % 3 != 0, "TimeoutError"))
    return out.select("event_id", "cache_key", "state", "result", "cache", "refresh_error")


def redact_model_input(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", F.lit("see https://x.org/a?token=abc1234&x=1 or 2001:db8::1")).alias("text"))
    return redact.redact_model_input(rows, F.col("text")).select("doc_id", "redacted", "n_redactions")


def scrape_document(spark, d):
    p = _read(spark, d).select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), F.col("p.text").alias("content"), F.lit(None).cast("string").alias("published_at"), F.lit(None).cast("string").alias("modified_at"), F.col("p.declared.author").alias("author"), F.col("p.declared.language").alias("language"), F.col("p.links").alias("links"))
    return tables.scrape_document(p).select("url", F.length("markdown").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"), F.substring("markdown", 1, 60).alias("begins"))


def network_responses(spark, d):
    """The responses that network_score scores, each URL twice; the best of the first sightings."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("ix"), F.concat("url", F.when(F.col("page_id") % 2 == 0, "/api/data.json").otherwise("")).alias("url"), F.lit(200).alias("status"), F.when(F.col("page_id") % 3 == 0, "application/json").otherwise("text/plain").alias("content_type"), F.col("html").alias("text"))
    rows = rows.unionByName(rows.withColumn("ix", F.col("ix") + 1_000_000_000))
    terms = network.relevance_terms(F.lit("thing about example data"), F.array().cast("array<string>"))
    return network.select_network(network.network_scores(rows, terms, F.lit("www.example.com"))).select("ix", "url", "score")


def evaluation_report(spark, d):
    return evaluation.report(evaluation_rows(spark, d))


def search_envelope(spark, d):
    rows = ranking.top_k(_hits(spark, d), [F.desc("discovery_score"), F.col("ix")], 12, ["request_id"]).select("request_id", "position", "url")
    out = tables.search_envelope(rows)
    return out.select("request_id", "number_of_results", F.array_join(F.transform("results", lambda x: x["url"]), " ").alias("urls"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "canonical_url citation_url evidence_id domain root_domain sensitive_key extract_urls source_adjustment source_profile tokens lexical_score lexical_rerank subject_coverage mode_for temporal_requirement categories engines query_variants normalize_date freshness version_markers normalize_heading ranking_score body_format usable_pages best_attempt cache_state chunks redact_secrets redact_pii dedup_candidates top_candidates diversified snippet_fallback top_passages page_content prefilter_passages evidence_summary latency_summary network_score html_to_text page_title page_metadata page_links flatten_props normalized_hits url_policy redact_url follow_links passages distinct_lines table_like_rows confidence searx_view evaluation_rows relevant_lines section_map should_capture direct_candidates task_kind page_labels extraction_sufficient decode_body assembled_results crawl_outcomes distinct_snapshots merged_text rerank cache_lookup redact_model_input scrape_document network_responses evaluation_report search_envelope rerank_status"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    return ORACLES | MORE
