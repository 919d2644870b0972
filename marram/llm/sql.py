"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_CLASSES = (r"\p{Lu}", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-", r"#*$%&|<>@\\^_`{}~+=/\[\]")
_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{c}]+', '', 'g'))::DOUBLE" for c in _CLASSES)
_TERM = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
_BOTH = _TERM.format(x="a", a="a", b="b") + " + " + _TERM.format(x="b", a="a", b="b")
#: op1: base counts, and Jensen-Shannon distances to the counts of the language, which lean on those of all documents.
OP1 = rf"""
WITH d AS (
  SELECT doc_id, t, lang, h || [length(t) - list_sum(h)] AS hist
  FROM (SELECT *, [{_COUNTS}] AS h FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents))),
r AS (SELECT d.*, lang AS ref FROM d),
w AS (
  SELECT doc_id, lang, ref, unnest(l) AS w, generate_subscripts(l, 1) AS i
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM r)),
g AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
under AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
of_lang AS (SELECT lang AS ref, lower(w) AS w, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
totals AS (SELECT ref, sum(n) AS total FROM of_lang GROUP BY ref),
of_all AS (SELECT w, sum(n) AS n, sum(n) / (SELECT sum(n) FROM of_lang) AS share FROM of_lang GROUP BY w),
every_word AS (SELECT t.ref, t.total, a.w, a.share, coalesce(o.n, 0) AS n
  FROM totals t CROSS JOIN of_all a LEFT JOIN of_lang o ON o.ref = t.ref AND o.w = a.w
  WHERE a.share >= 0.01 OR o.n >= 0.01 * t.total),
common AS (
  SELECT ref, w, CASE WHEN ref = '' THEN share ELSE (n + 400 * share) / (total + 400) END AS b FROM every_word
  WHERE CASE WHEN ref = '' THEN share ELSE (n + 400 * share) / (total + 400) END >= 0.01),
ref_words AS (SELECT ref, w, b FROM common
  UNION ALL SELECT ref, '' AS w, 1 - sum(b) AS b FROM common GROUP BY ref),
own_words AS (
  SELECT doc_id, coalesce(common.w, '') AS w, count(*)::DOUBLE AS n
  FROM w LEFT JOIN common ON common.ref = w.ref AND common.w = lower(w.w) GROUP BY ALL),
word_pairs AS (
  SELECT r.doc_id, coalesce(o.n, 0) / c.n_words AS a, q.b
  FROM r JOIN counted c USING (doc_id) JOIN ref_words q ON q.ref = r.ref LEFT JOIN own_words o ON o.doc_id = r.doc_id AND o.w = q.w),
word_js AS (SELECT doc_id, sqrt(greatest(0, sum({_BOTH}) / 2)) AS word_distance FROM word_pairs GROUP BY doc_id),
bins AS (SELECT doc_id, lang, ref, unnest(hist) AS n, generate_subscripts(hist, 1) AS k, length(t) AS size FROM r),
all_bins AS (SELECT k, sum(n) AS n FROM bins GROUP BY k),
ref_bins AS (
  SELECT lang AS ref, k, CASE WHEN lang = '' THEN any_value(a.n) ELSE sum(bins.n) + 2000 * any_value(a.n) / (SELECT sum(n) FROM all_bins) END AS n
  FROM bins JOIN all_bins a USING (k) GROUP BY lang, k),
char_pairs AS (
  SELECT doc_id, bins.n / size AS a, q.n / sum(q.n) OVER (PARTITION BY doc_id) AS b
  FROM bins JOIN ref_bins q USING (ref, k) WHERE size > 0),
char_js AS (SELECT doc_id, sqrt(greatest(0, sum({_BOTH}) / 2)) AS char_distance FROM char_pairs GROUP BY doc_id),
every AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS size, char_distance, word_distance
  FROM r LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN under USING (doc_id)
  LEFT JOIN char_js USING (doc_id) LEFT JOIN word_js USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND NOT coalesce((char_distance > 0.28 AND size >= 200) OR (word_distance > 0.4 AND n_words >= 50), false) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every)
"""

#: op2: group by the digest of the text without white space.
OP2 = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM rows
WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

#: op7: sets of shingles joined shingle by shingle, links by exact counts, components by what each document reaches.
OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
         ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM g),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT g.doc_id, any_value(len(g.g))::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN reached r ON r.a = g.doc_id GROUP BY g.doc_id
"""

#: op9: lines on at least ten sources go.
OP9 = r"""
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
bare AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS b FROM parts),
wide AS (SELECT b FROM bare WHERE b <> '' GROUP BY b HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE w.b IS NOT NULL) AS removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE w.b IS NULL), '') AS text
  FROM bare LEFT JOIN wide w ON bare.b = w.b GROUP BY doc_id)
SELECT doc_id, removed, length(text) AS n_chars, sha256(text) AS text_sha256 FROM kept
"""

#: Strength of a level's prior, by moments over its groups with n outcomes, g good ones and the prior mean m.
FIT = """CASE WHEN coalesce(sum({n} * m * (1 - m) * ({n} - 1)), 0) <= 0 THEN 8.0
  WHEN (sum(({g} - {n} * m) ** 2) - sum({n} * m * (1 - m))) / sum({n} * m * (1 - m) * ({n} - 1)) <= 1 / (1e6 + 1) THEN 1e6
  ELSE greatest(1.0, sum({n} * m * (1 - m) * ({n} - 1)) / (sum(({g} - {n} * m) ** 2) - sum({n} * m * (1 - m))) - 1) END"""
#: op10: rules by a CASE from the longest to the shortest; reputation by four levels of group-by, quadrature of posteriors.
OP10 = rf"""
WITH u AS (
  SELECT page_id, coalesce(strpos(url, '://') > 0, false) AS known,
         substr(url, strpos(url, '://') + 3) AS rest
  FROM pages),
p AS (
  SELECT page_id,
         CASE WHEN known THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u),
l AS (SELECT doc_id AS page_id, avg(quality::DOUBLE) AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
seen AS (
  SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0.0) AS g,
         string_split(regexp_replace(host, ':\d*$', ''), '.') AS parts
  FROM p LEFT JOIN l USING (page_id) GROUP BY host),
deep AS (
  SELECT *, len(parts) AS k,
         length(parts[-1]) = 2 AND len(parts) >= 2
           AND coalesce(parts[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org'), false) AS two
  FROM seen),
hosts AS (
  SELECT host, n, g,
         CASE WHEN two THEN parts[-2] || '.' || parts[-1] ELSE parts[-1] END AS suffix,
         CASE WHEN two AND k >= 3 THEN parts[-3] || '.' || parts[-2] || '.' || parts[-1]
              WHEN NOT two AND k >= 2 THEN parts[-2] || '.' || parts[-1]
              ELSE array_to_string(parts, '.') END AS domain
  FROM deep),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(g) AS dg FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dg) AS sg FROM domains GROUP BY suffix),
top AS (SELECT every, 0.5 * every / (1 - every) AS odds FROM (SELECT (coalesce(sum(sg), 0) + 0.5) / (coalesce(sum(sn), 0) + 1) AS every FROM suffixes)),
all_labels AS (SELECT coalesce(sum(sn), 0) AS n, coalesce(sum(sg), 0) AS g FROM suffixes),
s0 AS (SELECT suffix, sn, sg, (g - sg + 0.5) / (n - sn + 1) AS m FROM suffixes, all_labels),
s1 AS (SELECT {FIT.format(n="sn", g="sg")} AS k FROM s0),
d0 AS (SELECT domain, dn, dg, (sg - dg + k * m) / (sn - dn + k) AS m FROM domains JOIN s0 USING (suffix), s1),
d1 AS (SELECT {FIT.format(n="dn", g="dg")} AS k FROM d0),
h0 AS (SELECT host, n, g, (dg - g + k * m) / (dn - n + k) AS m FROM hosts JOIN d0 USING (domain), d1),
h1 AS (SELECT {FIT.format(n="n", g="g")} AS k FROM h0),
h AS (SELECT host, g + k * m AS a, n - g + k * (1 - m) AS b, ln(odds) AS cut FROM h0, h1, top),
grid AS (SELECT host, a, b, cut, ln(a / b) AS mid, ln(a / b) - 12 * sqrt(1 / a + 1 / b) - 8 / a AS low,
         (24 * sqrt(1 / a + 1 / b) + 8 / a + 8 / b) / 600 AS w FROM h),
cells AS (SELECT host, a, b, mid, w, cut, low + w * k AS lo, low + w * k + w / 2 AS z FROM grid, range(600) t(k)),
dens AS (
  SELECT host, least(1.0, greatest(0.0, (cut - lo) / w)) AS part,
         exp(a * (z - mid) - (a + b) * (greatest(z, 0) + ln(1 + exp(-abs(z))) - greatest(mid, 0) - ln(1 + exp(-abs(mid))))) AS f
  FROM cells),
r AS (SELECT host, sum(f * part) / sum(f) AS bad FROM dens GROUP BY host),
j AS (
  SELECT page_id, host, path, bad,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN r USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bad >= 0.9 THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_exact_dedup": OP2, "op7_jaccard_join": OP7, "op9_line_spread": OP9, "op10_host_reputation": OP10}
