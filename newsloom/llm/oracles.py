"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
), deg AS (SELECT u, count(*) AS n FROM link GROUP BY u),
comp AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN deg ON deg.u = vec_id JOIN comp ON comp.u = vec_id
"""

OP4 = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda k: CAST(concat('0x', substr(h, 2 * k + 1, 2)) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM raw, tab
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM sized
), dealt AS (
  SELECT doc_id, size, text_crc32, CAST((2 * upto - size) * 40 // (2 * total) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""

WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))
), hit AS (SELECT doc_id, item_id, p, n FROM runs JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10 = r"""
WITH l AS (
  SELECT doc_id, i, line, trim(regexp_replace(line, '[\t\r\x0B\x0C]', ' ', 'g')) AS c
  FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))
), b AS (
  SELECT doc_id, i, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3
  FROM l WHERE c <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i, i2, i3, row_number() OVER (PARTITION BY c, c2, c3 ORDER BY doc_id, i) AS nth FROM b WHERE c3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, x AS i FROM (SELECT doc_id, unnest([i, i2, i3]) AS x FROM n WHERE nth > 1)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
  FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(strlen(coalesce(kept, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH piece AS (
  SELECT lang, w, count(*) AS m FROM (
    SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents))
  WHERE len(w) > 0 GROUP BY ALL
), gram AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, CAST(sum(m) AS BIGINT) AS f
  FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM gram WHERE k > 1 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f), cut) AS nth
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN gram x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN gram y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')
), covered AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand WHERE k > 2))) GROUP BY ALL
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, c.score
  FROM cut c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase WHERE nth = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < 80 * CAST(c.a AS HUGEINT))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

TERMS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {TERMS} AS t FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
q AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, docs),
s AS (
  SELECT item, item_id, row, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": OP3,
    "op4_sharding": OP4,
    "op9_benchmark_decontamination": OP9,
    "op10_line_dedup": OP10,
    "op12_collocations": OP12,
    "op13_ranked_search": OP13,
}
