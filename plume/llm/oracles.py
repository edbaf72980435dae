"""SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from plume.llm.quality_rules import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS k FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: One more of the times that a source is gone through.
GO_THROUGH = """
f{b} AS (SELECT *, NOT got AND rank IS NOT NULL AND size <= gap AS fits FROM r{a}),
o{b} AS (SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN got THEN NULL ELSE rank END NULLS LAST, doc_id) <= gap AS more FROM f{b}),
r{b} AS (SELECT * EXCLUDE (gap, got, fits, more), gap - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0) AS gap, got OR more AS got FROM o{b})"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM w WINDOW o AS (ORDER BY most / weight::DOUBLE, source NULLS LAST)),
l AS (SELECT *, first_value(CASE WHEN own * weight <= most THEN own END IGNORE NULLS) OVER (ORDER BY most / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS level FROM f),
t AS (SELECT source, source_size, least(CASE WHEN level IS NULL THEN most::DOUBLE ELSE level * weight END, most::DOUBLE) AS target FROM l),
g AS (SELECT d.source, size, source_size, target, CAST(floor(sqrt(size) * 1024) AS BIGINT) AS measure, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
e AS (SELECT *, (target - coalesce(sum(2 * size::HUGEINT * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / nullif(sum(size::HUGEINT * n * measure) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS own FROM g WINDOW o AS (PARTITION BY source ORDER BY size DESC)),
v AS (SELECT *, first_value(CASE WHEN own * measure <= 2 THEN own END IGNORE NULLS) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS c FROM e),
y AS (SELECT source, size, source_size, target, greatest(CASE WHEN c IS NULL THEN 2e0 ELSE least(c * measure, 2e0) END, 0e0) AS expected FROM v),
u AS (SELECT d.doc_id, d.source, d.size, source_size, target, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS part,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.size = y.size),
r0 AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) * ((1 - part) / part) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS gap, false AS got FROM u),
{",".join(GO_THROUGH.format(a=k, b=k + 1) for k in range(3))},
b AS (SELECT source AS bs, arg_min(doc_id, (abs(gap - size), rank, doc_id)) AS best FROM r3 WHERE NOT got AND rank IS NOT NULL AND size > 0 AND size < 2 * gap GROUP BY source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN got OR doc_id = best THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r3 LEFT JOIN b ON source IS NOT DISTINCT FROM bs"""

STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
  len(list_filter(w, lambda x: suffix(x, '!') OR x = '|')) AS n_marks, len(list_filter(w, lambda x: lower(x) IN ({STOPS}))) AS n_stops FROM d),
v AS (SELECT m.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 2 AND 14 AND n_symbols / n <= 0.2e0 AND n_marks / n <= 0.25e0 AND n_stops / n >= 0.02e0 AND n_dup_lines / greatest(len(lines), 1)::DOUBLE <= 0.5e0 AS kept
FROM b"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS set FROM d),
n AS (SELECT doc_id, CAST(len(set) AS BIGINT) AS n_shingles FROM g),
x AS (SELECT doc_id, hash(unnest(set)) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS pos FROM n UNION SELECT doc_id, e.b FROM reach JOIN e ON e.a = reach.pos)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(pos) AS component_id, doc_id = min(pos) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
near AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98e0),
reached AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, n.w FROM reached r JOIN near n ON r.w = n.u),
c AS (SELECT u, min(w) AS component_id FROM reached GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM near GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""

ORACLE = {"op1_substrings": REPEATS, "op5_mixing": MIX, "op6_quality_rules": RULES, "op8_near_duplicates": NEAR, "op11_near_vectors": NEAR_VECTORS}
