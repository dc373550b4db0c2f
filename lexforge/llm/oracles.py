"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)
), dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1
), rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r
), m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_intersect(w, [{stops}])) AS n_stop
  FROM t LEFT JOIN rep USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.5 AND (n_words < 200 OR n_stop >= 1)
    AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / n_words <= 0.3 AS kept FROM b
"""

OP11 = r"""
WITH told AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id
), t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text
), f AS (
  SELECT t.part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 10 * length(t.text) AS c,
    regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > firsts.first, false) AS e, coalesce(good, 0) AS good, coalesce(told.toxic, 0) AS toxic
  FROM t JOIN firsts USING (text) LEFT JOIN told USING (doc_id)
), m AS (
  SELECT part, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS v
), o AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.v, q.v, r.v, s.v, u.v] AS bits FROM x p, x q, x r, x s, x u
  WHERE p.v + q.v + r.v + s.v + u.v = 31 AND len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5
), k AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN k GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""

OP12 = r"""
WITH t AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, CASE source WHEN 'partner' THEN 4 WHEN 'store' THEN 3 WHEN 'web' THEN 2 WHEN 'crm' THEN 1 ELSE 0 END AS trust,
    CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
    CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment, CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city, nation_id, balance FROM clients
), s AS (
  SELECT *, NOT coalesce(max(updated_at) OVER (PARTITION BY cluster_id) - updated_at <= INTERVAL 720 HOUR, false) AS stale, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM t
), seg AS (
  SELECT DISTINCT ON (cluster_id) cluster_id, segment, client_id FROM s WHERE segment IS NOT NULL ORDER BY cluster_id, updated_at DESC NULLS LAST, trust DESC, client_id NULLS LAST
), mail AS (
  SELECT DISTINCT ON (cluster_id) cluster_id, email, client_id FROM s WHERE email IS NOT NULL ORDER BY cluster_id, stale, trust DESC, updated_at DESC NULLS LAST, client_id NULLS LAST
), nam AS (
  SELECT DISTINCT ON (cluster_id) cluster_id, name, client_id FROM s WHERE name IS NOT NULL ORDER BY cluster_id, length(name) DESC, stale, trust DESC, updated_at DESC NULLS LAST, client_id NULLS LAST
), bal AS (
  SELECT DISTINCT ON (s.cluster_id) s.cluster_id, balance, s.client_id FROM s LEFT JOIN seg ON seg.cluster_id = s.cluster_id WHERE balance IS NOT NULL
  ORDER BY s.cluster_id, s.segment IS NOT DISTINCT FROM seg.segment DESC, updated_at DESC NULLS LAST, trust DESC, s.client_id NULLS LAST
), addr AS (
  SELECT DISTINCT ON (cluster_id) cluster_id, city, nation_id, CASE WHEN filled > 0 THEN client_id END AS client_id FROM s
  ORDER BY cluster_id, filled DESC, stale, trust DESC, updated_at DESC NULLS LAST, client_id NULLS LAST
), n AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale FROM s GROUP BY cluster_id)
SELECT n.cluster_id, n_records, n_stale, name, email, segment, city, nation_id, floor(100 * balance + 0.5)::BIGINT AS balance_cents,
  nam.client_id AS name_from, mail.client_id AS email_from, seg.client_id AS segment_from, bal.client_id AS balance_from, addr.client_id AS address_from
FROM n LEFT JOIN nam USING (cluster_id) LEFT JOIN mail USING (cluster_id) LEFT JOIN seg USING (cluster_id) LEFT JOIN bal USING (cluster_id) LEFT JOIN addr USING (cluster_id)
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)
), g AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), x AS (SELECT l.*, g.k IS NOT NULL AND l.doc_id IS DISTINCT FROM g.top AS gone FROM l LEFT JOIN g USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY r
"""


def _oracles() -> dict[str, str]:
    from .quality_rules import STOP_WORDS

    return {"op1_minhash_near_dedup": OP1, "op8_quality_rules": OP8.replace("{stops}", ", ".join(f"'{w}'" for w in STOP_WORDS)), "op11_filter_audit": OP11, "op12_golden_records": OP12, "op13_line_dedup": OP13}


ORACLES = _oracles()
