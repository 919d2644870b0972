"""DuckDB SQL for the retrieval queries that SQL can express."""

from __future__ import annotations

from marram import rules

_HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"
_DOMAIN = rf"regexp_replace({_HOST}, '^www\.', '')"
_CANONICAL = rf"lower(regexp_extract(url, '^(https?)://', 1)) || '://' || {_HOST} || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') || CASE WHEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END"
_ROOT = rf"array_to_string(list_slice(string_split({_DOMAIN}, '.'), -2, -1), '.')"
_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_QUERY = "restes onnd thingha erand ofther nterthing"
_HITS = rf"(SELECT page_id AS ix, page_id % 7 AS request_id, {_DOMAIN} AS domain, url, round((length(html) % 97) / 10.0, 2) AS discovery_score FROM pages)"


def _has(intent: str, column: str = "text") -> str:
    return f"regexp_matches(coalesce({column}, ''), '(?i)' || '{rules.INTENT[intent]}')"


def _score(column: str) -> str:
    low = f"replace(lower(coalesce({column}, '')), 'ß', 'ss')"
    words = _QUERY.split()
    hits = " + ".join(f"contains({low}, '{w}')::INT" for w in words)
    return f"(({hits}) / {len(words)}.0 + CASE WHEN contains({low}, '{_QUERY}') THEN 0.25 ELSE 0 END)::DOUBLE"


_PASSAGES = f"""(SELECT doc_id, pos - 1 AS passage_index, line AS text, {_score('line')} AS lexical_score, (doc_id % 5)::DOUBLE AS source_score
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""

def _in(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"d = '{n}' OR ends_with(d, '.{n}')" for n in names) + ")"


_WORDS = "list_distinct(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[a-z0-9]{{3,}}'))"
_PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/')"
_PROFILE = f"""
WITH p AS (SELECT page_id, {_DOMAIN} AS d, {_PATH} AS path, {_ROOT} AS root FROM pages),
k AS (SELECT *, list_has_any({_WORDS.format(x="root || ' ' || substr(path, 1, 500)")}, ['example']) AS near, CASE
  WHEN d = '' THEN ['general_web', '5', '0', 'no']
  WHEN {_in(rules.LOW_QUALITY_DOMAINS)} THEN ['low_quality_or_social', '5', '0.08', 'no']
  WHEN ends_with(d, '.gov') OR contains(d, '.gov.') OR {_in(("europa.eu",))} THEN ['government', '1', '0.96', 'yes']
  WHEN {_in(rules.STANDARD_DOMAINS)} THEN ['standard', '1', '0.95', 'yes']
  WHEN {_in(rules.ACADEMIC_DOMAINS)} OR ends_with(d, '.edu') OR contains(d, '.edu.') THEN ['academic_primary', '1', '0.91', 'yes']
  WHEN {_in(("github.com",))} AND regexp_matches(path, '(?i){rules.DISCUSSION_PATH}') THEN ['technical_community', '3', '0.66', 'no']
  WHEN {_in(("github.com",))} AND regexp_matches(path, '(?i){rules.RELEASE_PATH}') THEN ['release_notes', '1', '0.9', 'affine']
  WHEN {_in(("github.com",))} THEN ['source_repository', '2', '0.84', 'affine']
  WHEN {_in(rules.DOCUMENTATION_DOMAINS)} THEN ['documentation_candidate', '1', '0.93', 'yes']
  WHEN regexp_matches(d, '^(docs|developer|support)[.]') OR regexp_matches(path, '(?i){rules.DOCUMENTATION_PATH}') THEN ['documentation_candidate', '2', '0.81', 'affine']
  WHEN {_in(rules.TECHNICAL_DOMAINS)} THEN ['technical_reference', '2', '0.78', 'no']
  WHEN {_in(rules.NEWS_DOMAINS)} THEN ['news', '2', '0.79', 'no']
  WHEN {_in(rules.COMMUNITY_DOMAINS)} OR contains(d, 'forum') THEN ['technical_community', '3', '0.61', 'no']
  ELSE ['general_web', '4', '0.45', 'no'] END AS k FROM p)
SELECT page_id, k[1] AS source_type, k[2]::INT AS source_tier,
       round(CASE WHEN near AND k[1] IN ('documentation_candidate', 'release_notes', 'source_repository') THEN least(1.0, k[3]::DOUBLE + 0.04) ELSE k[3]::DOUBLE END, 4)::DOUBLE AS authority_score,
       [1.35, 0.7, 0.2, 0.0, -2.0][k[2]::INT]::DOUBLE AS authority_adjustment,
       k[4] = 'yes' OR (k[4] = 'affine' AND near) AS primary_source_candidate, near AS query_domain_affinity
FROM k
"""
_PAD = "' ' || replace(replace(coalesce(text, ''), chr(10), '  '), ' ', '  ') || ' '"
_TERMS = _QUERY.split()
_Q = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"

ORACLES = {
    "source_profile": _PROFILE,
    "subject_coverage": "SELECT doc_id, round((" + " + ".join(f"regexp_matches({_PAD}, '(?i)[^\\p{{L}}\\p{{N}}_]{w}[^\\p{{L}}\\p{{N}}_]')::INT" for w in _TERMS) + f") / {len(_TERMS)}.0, 6)::DOUBLE AS subject_coverage FROM documents",
    "flatten_props": "SELECT event_id, regexp_replace(regexp_replace(props, '[{}\"]', '', 'g'), ':\\s*', ': ', 'g') AS flat FROM events",
    "query_variants": f"SELECT conv_id, turn, (generate_subscripts(v, 1) - 1)::INT AS variant_ix, unnest(v) AS variant FROM (SELECT conv_id, turn, (list_filter([q, CASE WHEN {_has('docker_documentation', 'q')} THEN q || ' site:docs.docker.com' WHEN {_has('technical', 'q')} AND {_has('instruction', 'q')} THEN q || ' official documentation' WHEN {_has('current', 'q')} THEN q || ' latest' WHEN {_has('technical', 'q')} THEN q || ' official documentation' END, q || ' authoritative sources'], lambda x: x IS NOT NULL)) AS v FROM (SELECT conv_id, turn, {_Q} AS q FROM conversations))",
    "canonical_url": f"SELECT page_id, {_CANONICAL} AS canonical_url FROM pages",
    "citation_url": f"SELECT page_id, {_CANONICAL} AS citation_url FROM pages",
    "evidence_id": f"SELECT page_id, 'ev-' || substr(sha256({_CANONICAL}), 1, 16) AS evidence_id FROM pages",
    "domain": f"SELECT page_id, {_DOMAIN} AS domain FROM pages",
    "root_domain": f"SELECT page_id, {_ROOT} AS root_domain FROM pages",
    "extract_urls": f"SELECT page_id, {_CANONICAL} AS urls FROM pages",
    "tokens": rf"WITH l AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}\p{{M}}]+(?:[-.][\p{{L}}\p{{N}}\p{{M}}]+)*') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM l), f AS (SELECT doc_id, w, min(i) AS i FROM u WHERE (length(w) >= 2 OR regexp_matches(w, '^\d+$')) AND w NOT IN ({_STOP}) GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY n) FILTER (WHERE n <= 80), '') AS tokens FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id",
    "page_title": r"SELECT page_id, nullif(substr(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g')), 1, 500), '') AS title FROM pages",
    "lexical_score": f"SELECT doc_id, round({_score('text')}, 6) AS lexical_score FROM documents",
    "lexical_rerank": f"SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id)::INT AS position, round(s, 6) AS rerank_score, round(s, 6) AS ranking_score FROM (SELECT doc_id, {_score('text')} AS s FROM documents) ORDER BY s DESC, doc_id LIMIT 20",
    "mode_for": f"SELECT conv_id, turn, CASE WHEN {_has('technical')} OR {_has('recommendation')} THEN 'balanced' WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) <= 9 THEN 'quick' ELSE 'balanced' END AS mode FROM conversations",
    "temporal_requirement": f"SELECT conv_id, turn, CASE WHEN {_has('current_query')} THEN 'high' WHEN {_has('version_sensitive')} THEN 'moderate' ELSE 'none' END AS temporal_requirement FROM conversations",
    "categories": f"SELECT conv_id, turn, 'general' || CASE WHEN {_has('technical')} THEN ',it' ELSE '' END || CASE WHEN {_has('current')} THEN ',news' ELSE '' END || CASE WHEN {_has('academic')} THEN ',science' ELSE '' END || CASE WHEN {_has('image')} THEN ',images' ELSE '' END AS categories FROM conversations",
    "engines": f"SELECT conv_id, turn, 'startpage,bing,brave' || CASE WHEN {_has('technical')} AND {_has('web_platform')} THEN ',mdn' ELSE '' END || CASE WHEN {_has('technical')} AND ({_has('programming')} OR {_has('troubleshoot')}) THEN ',stackoverflow' ELSE '' END || CASE WHEN {_has('technical')} AND {_has('ubuntu')} THEN ',askubuntu' ELSE '' END || CASE WHEN {_has('current')} THEN ',startpage news,bing news,brave.news,reuters' ELSE '' END || CASE WHEN {_has('academic')} THEN ',arxiv,pubmed,semantic scholar,openalex,crossref' ELSE '' END || CASE WHEN {_has('image')} THEN ',startpage images,bing images,brave.images,wikicommons.images' ELSE '' END AS engines FROM conversations",
    "freshness": "SELECT event_id, CASE WHEN d < -2 THEN 0.0 ELSE round(CASE WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.9 WHEN d <= 90 THEN 0.72 WHEN d <= 365 THEN 0.48 WHEN d <= 1095 THEN 0.2 ELSE 0.05 END::DOUBLE * CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0.5 END, 4) END::DOUBLE AS freshness FROM (SELECT event_id, user_id, (epoch(TIMESTAMP '2024-06-30') - floor(epoch(ts))) / 86400.0 AS d FROM events)",
    "ranking_score": "SELECT event_id, round(1.0 + 0.12 * greatest(-4.0, least(4.0, coalesce(value, 0) / 20)), 6)::DOUBLE AS ranking_score FROM events",
    "body_format": "SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*[{\\[]') THEN 'json' WHEN contains(lower(substr(html, 1, 2000)), '<html') THEN 'html' ELSE 'text' END AS format FROM pages",
    "usable_pages": "SELECT doc_id, length(t) >= 900 AND (" + " + ".join(f"contains(lower(substr(t, 1, 3000)), '{m}')::INT" for m in rules.CHALLENGE_MARKERS) + ") < 2 AS usable FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
    "best_attempt": "SELECT url, tier, content_chars, NOT good AS low_confidence FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY good DESC, CASE WHEN good THEN tier END, content_chars DESC, tier) AS rn FROM (SELECT 'u' || (doc_id // 3) AS url, (doc_id % 3 + 1)::INT AS tier, length(text) AS content_chars, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= [900, 500, 400][doc_id % 3 + 1] AS good FROM documents)) WHERE rn = 1",
    "cache_state": "SELECT event_id, CASE WHEN age <= 900 THEN 'fresh' WHEN age <= 86400 THEN 'stale' ELSE 'expired' END AS state FROM (SELECT event_id, ((epoch(TIMESTAMP '2024-06-30')::BIGINT - floor(epoch(ts))::BIGINT) % 200000 + 200000) % 200000 AS age FROM events)",
    "dedup_candidates": f"SELECT request_id, domain, arg_max(url, (discovery_score, -ix)) AS url, arg_max(ix, (discovery_score, -ix)) AS ix, max(discovery_score) AS discovery_score, min(ix) AS first_seen_ix FROM {_HITS} GROUP BY request_id, domain",
    "top_candidates": f"SELECT ix, discovery_score, row_number() OVER (ORDER BY discovery_score DESC, ix)::INT AS position FROM {_HITS} ORDER BY discovery_score DESC, ix LIMIT 30",
    "diversified": f"SELECT request_id, ix, owner, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY again, discovery_score DESC, ix)::INT AS position FROM (SELECT *, owner <> '' AND row_number() OVER (PARTITION BY request_id, owner ORDER BY discovery_score DESC, ix) > 1 AS again FROM (SELECT *, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS owner FROM {_HITS}))) WHERE position <= 8",
    "snippet_fallback": f"SELECT request_id, url, is_fallback, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY is_fallback, ix, url)::INT AS position FROM (SELECT request_id, url, false AS is_fallback, ix FROM {_HITS} WHERE ix % 3 = 0 UNION ALL SELECT request_id, url, true, ix FROM {_HITS} h WHERE NOT EXISTS (SELECT 1 FROM {_HITS} r WHERE r.ix % 3 = 0 AND r.request_id = h.request_id AND r.url = h.url))) WHERE position <= 40",
    "top_passages": f"SELECT doc_id, passage_index::INT AS passage_index, round(lexical_score, 6) AS lexical_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lexical_score DESC, passage_index)::INT AS rank FROM {_PASSAGES}) WHERE rank <= 3",
    "page_content": f"SELECT doc_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY rank), 1, 7000) AS content, round(max(lexical_score), 6) AS page_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lexical_score DESC, passage_index) AS rank FROM {_PASSAGES}) WHERE rank <= 3 GROUP BY doc_id",
    "prefilter_passages": f"SELECT doc_id, passage_index::INT AS passage_index, row_number() OVER (ORDER BY lexical_score + 0.08 * source_score DESC, doc_id * 100000 + passage_index)::INT AS position FROM {_PASSAGES} WHERE lexical_score > 0 OR passage_index <= 6 ORDER BY position LIMIT 80",
    "latency_summary": "SELECT event_type, count(*) AS cases, count(*) FILTER (WHERE value > 50) AS passed, round(count(*) FILTER (WHERE value > 50) / count(*), 4) AS pass_rate, round(median(value), 3) AS median_latency, round(list_sort(list(value))[greatest(1, least(count(*), round_even(0.95 * count(*), 0)::BIGINT))], 3) AS p95_latency FROM events GROUP BY event_type",
    "confidence": "SELECT event_id, CASE WHEN event_id % 2 > 0 AND event_id % 3 > 0 THEN 'high' WHEN event_id % 2 > 0 OR event_id % 40 >= 20 THEN 'medium_high' WHEN event_id % 5 > 0 THEN 'medium' WHEN event_id % 1000 > 500 THEN 'low' ELSE 'very_low' END AS confidence FROM events",
    "distinct_lines": "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ix, line FROM (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) AS rn FROM (SELECT doc_id, i, trim(regexp_replace(line, '^\\s*[-•]\\s+|\\s+$', '', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> '') WHERE rn = 1",
    "searx_view": f"SELECT request_id, url, domain AS title, '' AS content, 'gateway' AS engine, discovery_score AS score, NULL::VARCHAR AS publishedDate FROM {_HITS}",
    "evidence_summary": f"SELECT request_id, 'sufficient' AS status, n AS result_count, owners AS independent_source_count, primaries AS primary_source_candidate_count, dated AS dated_source_count, extracted AS extracted_source_count, n AS citation_url_count, 'high' AS temporal_requirement, '' AS version_contexts, array_to_string(list_filter([CASE WHEN n > 1 AND owners < 2 THEN 'Limited independent-source diversity.' END, CASE WHEN primaries = 0 THEN 'No likely primary or authoritative source was identified.' END, CASE WHEN dated = 0 THEN 'The request is time-sensitive, but sources exposed no usable publication or modification dates.' END, 'No explicit software or product version context was extracted.', CASE WHEN extracted < n THEN 'Some results rely on search snippets because page extraction was unavailable.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM (SELECT request_id, count(*) AS n, count(DISTINCT array_to_string(list_slice(string_split(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.'), -2, -1), '.')) AS owners, count(*) FILTER (WHERE ix % 11 = 0) AS primaries, count(*) FILTER (WHERE ix % 5 = 0) AS dated, count(*) FILTER (WHERE ix % 4 <> 0) AS extracted FROM {_HITS} GROUP BY request_id)",
}
