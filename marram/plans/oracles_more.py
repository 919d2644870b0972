"""DuckDB SQL for tasks, crawling, caches and assembly."""

from __future__ import annotations

from marram import rules
from marram.operators.sections import ALIASES, DOCUMENTATION, PRODUCT
from marram.plans.oracles import _DOMAIN, _HITS, _QUERY, _ROOT, ORACLES, _score

_TASK = """(SELECT conv_id, turn, lower(coalesce(task, '')) AS low, coalesce(task, '') AS task FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0
  THEN (['install the docker compose plugin', 'list all rows of the table', 'oem cross reference of a filter', 'the "Known Issues" of this release', 'price and security'])[((conv_id + 3 * turn) % 5 + 1)::INT]
  ELSE text END AS task FROM conversations))"""


def _mentions(terms: tuple[str, ...], column: str = "low") -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_PRODUCT, _DOCUMENTATION = _mentions(rules.PRODUCT_TERMS), _mentions((*rules.DOCUMENTATION_TERMS, *rules.DOCUMENTATION_PHRASES))
_LABELS = " || ".join([
    f"CASE WHEN {_DOCUMENTATION} THEN {_list(DOCUMENTATION)} ELSE []::VARCHAR[] END", f"CASE WHEN {_PRODUCT} THEN {_list(PRODUCT)} ELSE []::VARCHAR[] END",
    *[f"CASE WHEN {_mentions(t)} THEN {_list(g)} ELSE []::VARCHAR[] END" for t, g in zip(rules.LABEL_TERMS, ALIASES, strict=True)], "regexp_extract_all(task, '\"([^\"]{3,80})\"', 1)",
])
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)"
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

_ADJUSTED = sorted(rules.DOMAIN_BOOSTS | rules.DOMAIN_PENALTIES)
_WEIGHTS = " + ".join([
    "CASE split_part(d, '.', 1) WHEN 'docs' THEN 1.2 WHEN 'developer' THEN 1.0 WHEN 'support' THEN 0.9 ELSE 0.0 END",
    *[f"CASE WHEN d = '{n}' OR ends_with(d, '.{n}') THEN {v} ELSE 0.0 END" for n, v in (rules.DOMAIN_BOOSTS | rules.DOMAIN_PENALTIES).items()],
])
_COMPACT = "regexp_replace(lower(key), '[^a-z0-9]', '', 'g')"
_DAY = "'2024-03-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"

_W = r"\p{L}\p{N}\p{M}_"
_TERM = " OR ".join(f"contains(lower(line), '{w}')" for w in _QUERY.split())

MORE = {
    "rerank_status": "SELECT r AS request_id, CASE WHEN r = 11 THEN 'empty' WHEN r = 6 THEN 'fallback:deadline' WHEN r = 3 THEN 'fallback:invalid_response' WHEN r IN (4, 5) THEN 'partial' ELSE 'ok' END AS rerank_status FROM range(12) t(r)",
    "search_envelope": f"SELECT request_id, count(*) AS number_of_results, string_agg(url, ' ' ORDER BY position) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY discovery_score DESC, ix) AS position FROM {_HITS}) WHERE position <= 12 GROUP BY request_id",
    "table_like_rows": rf"""
SELECT doc_id, ix, line FROM ({ORACLES["distinct_lines"]})
WHERE regexp_matches(line, '\s{{2,}}|\||,|\t') OR regexp_matches(line, '(^|[^{_W}])(19|20)[0-9]{{2}}($|[^{_W}])') OR regexp_matches(line, '(^|[^{_W}])[A-Z0-9][A-Z0-9-]{{2,}}[A-Z0-9]($|[^{_W}])') OR {_TERM}""",
    "page_links": r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || regexp_extract(url, '^https?://([^/?#]*)', 1) AS base, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
u AS (SELECT page_id, base, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a),
v AS (SELECT page_id, i, base || regexp_extract(x, '<a href="([^"]*)"', 1) AS url, trim(regexp_replace(regexp_extract(x, '>([^<]*)<', 1), '\s+', ' ', 'g')) AS anchor FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS rn FROM v)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS link_ix, url, anchor FROM f WHERE rn = 1""",
    "normalize_heading": f"SELECT doc_id, k::INT AS ix, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS heading FROM {_LINES}",
    "sensitive_key": f"""
WITH u AS (SELECT page_id, url || '&' || (['Access-Token', 'X-Amz-Signature', 'session_key', 'sessionABC', 'my.password', 'page', 'monkey', 'PHPSESSID', 'client_secret2', 'Sig'])[(page_id % 10 + 1)::INT] || '=1' AS u FROM pages),
k AS (SELECT page_id, unnest(l) AS key, generate_subscripts(l, 1) - 1 AS ix FROM (SELECT page_id, regexp_extract_all(u, '[?&]([^=&#]+)=', 1) AS l FROM u))
SELECT page_id, ix::INT AS ix, key, replace(lower(key), '-', '_') IN ({', '.join(repr(k) for k in rules.SENSITIVE_KEYS)})
  OR {_COMPACT} IN ({', '.join(repr(k.replace('_', '')) for k in rules.SENSITIVE_KEYS)})
  OR regexp_matches({_COMPACT}, '^session|(token|secret|password|signature|credential|sessionid)$')
  OR regexp_matches(replace(lower(key), '-', '_'), '^session_|_(token|secret|password|signature|credential|session|session_id|sessionid)$') AS is_sensitive FROM k""",
    "source_adjustment": f"""
SELECT page_id, round(({_WEIGHTS})::DOUBLE, 4) AS source_adjustment FROM (
  SELECT page_id, CASE page_id // {len(_ADJUSTED)} % 4 WHEN 0 THEN n WHEN 1 THEN 'docs.' || n WHEN 2 THEN 'not' || n ELSE {_DOMAIN} END AS d
  FROM (SELECT *, ({_list(tuple(_ADJUSTED))})[(page_id % {len(_ADJUSTED)} + 1)::INT] AS n FROM pages))""",
    "normalize_date": """
SELECT event_id, CASE WHEN event_id % 10 IN (8, 9) THEN NULL WHEN event_id % 10 IN (2, 6, 7) OR date_trunc('second', ts) = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS normalized FROM events""",
    "page_metadata": f"""
SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language,
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'A' || page_id || ', B' ELSE 'Author ' || page_id END AS author,
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'LD' ELSE 'About ' || page_id END AS description,
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN {_DAY} ELSE {_DAY} || 'T10:00:00Z' END AS published_at,
       CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN NULL ELSE {_DAY} END AS modified_at FROM pages""",
    "task_kind": f"SELECT conv_id, turn, {_PRODUCT} AS is_product, {_DOCUMENTATION} AS is_documentation FROM {_TASK}",
    "page_labels": f"SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(low_l, lower(x)) = i), '|') AS labels FROM (SELECT *, list_transform(l, lambda y: lower(y)) AS low_l FROM (SELECT conv_id, turn, list_filter(list_transform({_LABELS}, lambda z: trim(z)), lambda z: z <> '') AS l FROM {_TASK}))",
    "extraction_sufficient": "SELECT event_id, (t = 0 AND r >= 20) OR (t = 1 AND (s OR r >= 10 OR l >= 10)) OR s OR l >= 8 OR (n > 0 AND c > 1000) OR (c > 3000 AND l >= 3) AS is_sufficient FROM (SELECT event_id, event_id % 3 AS t, event_id % 11 = 0 AS s, event_id % 29 AS r, event_id % 13 AS l, event_id % 2 AS n, event_id % 5000 AS c FROM events)",
    "decode_body": "SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256 FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 3 THEN chr(65533) ELSE '' END AS t FROM documents WHERE text IS NOT NULL)",
    "assembled_results": f"""
WITH page AS (SELECT page_id AS doc_id, page_id % 7 AS request_id, url, {_ROOT} AS owner FROM pages),
found AS (SELECT request_id, url, min(doc_id) AS ix FROM page GROUP BY ALL HAVING min(doc_id) % 3 <> 0),
p AS (SELECT page.doc_id, k, line, CASE WHEN k % 6 <> 5 THEN (length(line) % 97) / 10.0 ELSE 0.25 END AS s FROM {_LINES} JOIN page USING (doc_id)),
best AS (
  SELECT doc_id, substr(string_agg(line, chr(10) || chr(10) ORDER BY rank), 1, 7000) AS content, max(s) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS rank FROM p) WHERE rank <= 3 GROUP BY doc_id),
turns AS (SELECT page.*, content, score, owner <> '' AND row_number() OVER (PARTITION BY request_id, owner ORDER BY score DESC, doc_id) > 1 AS again FROM page JOIN best USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY again, score DESC, doc_id)::INT AS position FROM turns)
SELECT request_id, position, doc_id AS page_index, CASE WHEN doc_id % 4 <> 0 THEN 'Page ' || doc_id WHEN found.ix IS NOT NULL THEN 'Hit ' || found.ix ELSE url END AS title,
       url, content, CASE WHEN found.ix IS NULL THEN '' ELSE 'found' END AS snippet, round(score, 6)::DOUBLE AS score,
       CASE WHEN doc_id % 5 = 0 THEN '2024-05-01' WHEN found.ix IS NOT NULL THEN '2023-01-01' END AS published_at, CASE WHEN found.ix IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS freshness_score, url AS citation_url
FROM placed LEFT JOIN found USING (request_id, url) WHERE position <= 6""",
    "crawl_outcomes": """
WITH r AS (SELECT page_id AS ix, page_id % 7 AS request_id, url FROM pages),
d AS (SELECT request_id, url, min(CASE WHEN ix % 4 = 0 THEN 'TimeoutError' ELSE '' END) AS e FROM r WHERE ix % 3 <> 0 GROUP BY ALL)
SELECT request_id, url, ix, coalesce(e = '', false) AS fetched, CASE WHEN e IS NULL THEN 'deadline' ELSE nullif(e, '') END AS error FROM r LEFT JOIN d USING (request_id, url)""",
    "distinct_snapshots": f"SELECT doc_id, ix, sha256(t) AS text_sha256 FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY ix) AS last FROM (SELECT doc_id, k::INT AS ix, {_TRIM.format(x='line')} AS t FROM {_LINES}) WHERE t <> '') WHERE last IS NULL OR last <> t",
    "merged_text": rf"""
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256 FROM (
  SELECT doc_id, {_TRIM.format(x="regexp_replace(CASE WHEN body = '' THEN reply ELSE body || chr(10) || chr(10) || reply END, chr(10) || '{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS t
  FROM (SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS body, 'Network response: https://example.org/api' || chr(10) || substr(l[1] || repeat(chr(10), 5) || 'end ', 1, 4000) AS reply
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))""",
    "rerank": f"""
WITH r AS (SELECT doc_id % 7 AS request_id, doc_id AS ix, round({_score('text')}, 6) AS lexical, (doc_id % 9 - 4)::DOUBLE AS authority, doc_id % 3 = 0 AND doc_id % 10 <> 0 AS is_scored FROM documents),
s AS (SELECT *, CASE WHEN is_scored THEN (ix % 101) / 10.0 ELSE lexical END + 0.12 * authority AS ranking FROM r)
SELECT request_id, ix, position, is_scored, round(ranking, 6)::DOUBLE AS ranking_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY is_scored DESC, ranking DESC, ix)::INT AS position FROM s) WHERE position <= 20""",
    "cache_lookup": """
WITH e AS (SELECT 'k' || event_id % 997 AS cache_key, (event_id * 37) % 200000 AS age, event_id::VARCHAR AS result FROM events WHERE event_id % 2 = 0),
c AS (SELECT cache_key, min(age) AS age, arg_max(result, (-age, result)) AS result FROM e GROUP BY cache_key),
a AS (SELECT event_id, 'k' || event_id % 997 AS cache_key FROM events WHERE event_id % 5 = 0),
s AS (SELECT event_id, cache_key, event_id % 3 <> 0 AS failed, CASE WHEN age <= 900 THEN 'fresh' WHEN age <= 86400 THEN 'stale' WHEN age IS NOT NULL THEN 'expired' END AS state, CASE WHEN age <= 86400 THEN result END AS held FROM a LEFT JOIN c USING (cache_key))
SELECT event_id, cache_key, state,
       CASE WHEN state = 'fresh' OR (failed AND held IS NOT NULL) THEN held WHEN NOT failed THEN 'new ' || event_id END AS result,
       CASE WHEN state = 'fresh' THEN 'hit' WHEN NOT failed THEN 'miss' WHEN held IS NOT NULL THEN 'stale-fallback' ELSE 'error' END AS cache,
       CASE WHEN state IS DISTINCT FROM 'fresh' AND failed THEN 'TimeoutError' END AS refresh_error
FROM s""",
}
