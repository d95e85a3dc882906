"""DuckDB SQL of the queries that SQL can express. XXH64, tokenizers, classifiers and transport streams are beyond it."""

from __future__ import annotations

SQL: dict[str, str] = {
    "op4_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 starts AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS p FROM d),
 windows AS (SELECT starts.doc_id, p, array_to_string(w[p : p + 49], ' ') AS k FROM starts JOIN d USING (doc_id)),
 least_id AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 50)) AS p FROM windows JOIN least_id USING (k) WHERE doc_id > m),
 words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
 kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 k AS (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN m <> page_id THEN m END AS refers_to FROM k""",
    "op11_merkle": """
WITH RECURSIVE cells AS (SELECT doc_id, source, text, CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END
   || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
   || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END AS head FROM documents),
 crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
   lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS crc FROM cells),
 leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
   sha256(head || CASE WHEN text IS NULL THEN '-' WHEN coalesce(crc % 5 = 0, false) THEN octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE octet_length(encode(text)) || ':' || text END) AS changed FROM crc),
 placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
 up AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM placed UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY tree, level, i // 16),
 subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS trees FROM up WHERE n = 1),
 top AS (SELECT 'T' AS tree, 0 AS level, place AS i, subroot AS h, trees AS n FROM subroots UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY tree, level, i // 16),
 runs AS (SELECT tree, level, i // 16 AS r, string_agg(h, '' ORDER BY i) AS t, any_value(n) <= 16 AS ends FROM (SELECT * FROM up UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY ALL),
 fold AS (SELECT doc_id, leaf, i AS nth, placed.tree AS own_tree, CASE WHEN n > 1 THEN placed.tree WHEN trees > 1 THEN 'T' END AS tree, 0 AS level, CASE WHEN n > 1 THEN i ELSE place END AS i, changed AS own, '' AS proof FROM placed JOIN subroots USING (tree)
  UNION ALL SELECT doc_id, leaf, nth, own_tree, CASE WHEN NOT ends THEN fold.tree WHEN fold.tree <> 'T' AND trees > 1 THEN 'T' END, CASE WHEN ends THEN 0 ELSE fold.level + 1 END, CASE WHEN ends THEN place ELSE r END,
   sha256(left(t, 64 * (i % 16)) || own || substr(t, 64 * (i % 16) + 65)), proof || left(t, 64 * (i % 16)) || substr(t, 64 * (i % 16) + 65)
   FROM fold JOIN runs ON fold.tree = runs.tree AND fold.level = runs.level AND fold.i // 16 = r JOIN subroots ON fold.own_tree = subroots.tree)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = top.h AS verified FROM fold JOIN subroots ON own_tree = subroots.tree JOIN top ON top.n = 1 WHERE fold.tree IS NULL""",
    "op13_negatives": """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q AS a JOIN q AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
