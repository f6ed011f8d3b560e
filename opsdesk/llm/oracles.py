"""DuckDB statements for the queries that SQL can express on whole tables (small scales)."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), low AS (
  SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN low USING (s) WHERE first_doc < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t,
         count(gone.i) AS n_removed
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, base, length(h) // 2 - 49 - base AS windows, substr(h, 2 * base + 1, 2 * (256 + 49)) AS c
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 256)) AS base FROM d WHERE length(h) >= 100)
), win AS (
  SELECT doc_id, base + i AS i, substr(c, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, base, c, unnest(range(0, least(256, windows))) AS i FROM part)
), low AS (
  SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), starts AS (
  SELECT doc_id, i FROM win JOIN low USING (s) WHERE first_doc < doc_id
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS head FROM starts
), numbered AS (
  SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS body,
         max(b) AS tail, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE body || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), class AS (
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
), n AS (
  SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x
)
SELECT documents.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents JOIN class USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_WORDS9 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS9} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS9} AS w FROM benchmark WHERE item_id IS NOT NULL
), item AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), win AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item) AS sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, win.n, i FROM win JOIN item ON win.n = item.n AND win.s = item.s
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
              ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)
), fields AS (
  SELECT row_number() OVER () AS uid, CAST(doc_id AS BIGINT) AS doc_id, coalesce(':' || lang, '-') AS tree,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc
), leaves AS (
  SELECT uid, doc_id, tree, leaf, CASE WHEN tampered THEN sha256(head || low) ELSE leaf END AS start,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS pos
  FROM (SELECT *, sha256(head || body) AS leaf FROM fields)
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM nodes) WHERE c > 1 GROUP BY tree, level, pos // 8
), subroots AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place
  FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS top FROM nodes) WHERE level = top
), upper AS (
  SELECT 0 AS level, place AS pos, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY level, pos // 8
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs
  FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS c FROM
        (SELECT tree, level, pos, h FROM nodes UNION ALL SELECT '', level, pos, h FROM upper)) WHERE c > 1 GROUP BY ALL
), climb AS (
  SELECT uid, tree, 0 AS level, pos, start AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT uid, tree, level + 1, pos // 8,
         sha256(array_to_string(hs[:pos % 8], '') || h || array_to_string(hs[pos % 8 + 2:], '')),
         proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  FROM climb JOIN runs USING (tree, level) WHERE run = pos // 8
), climbed AS (
  SELECT uid, '' AS tree, 0 AS level, place AS pos, h, proof
  FROM climb JOIN subroots ON climb.tree = subroots.tree AND level = height
  UNION ALL
  SELECT uid, tree, level + 1, pos // 8,
         sha256(array_to_string(hs[:pos % 8], '') || h || array_to_string(hs[pos % 8 + 2:], '')),
         proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  FROM climbed JOIN runs USING (tree, level) WHERE run = pos // 8
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN climbed USING (uid)
JOIN (SELECT level, h AS root FROM upper ORDER BY level DESC LIMIT 1) USING (level)
"""

OP12 = r"""
WITH piece AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), place AS (
  SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) AS size(n) WHERE len(w) >= n
), f AS (
  SELECT lang, n AS size, array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS a FROM place GROUP BY ALL
), total AS (
  SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang
), candidate AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30
), inner_part AS (
  SELECT lang, a, m, w, unnest(range(1, size - m + 2)) AS i FROM candidate, (VALUES (2), (3)) AS part(m) WHERE m < size
), longer AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM inner_part GROUP BY ALL
), kept AS (
  SELECT candidate.* FROM candidate LEFT JOIN longer USING (lang, phrase)
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r,
         CAST(2000000 * CAST(cut.a AS HUGEINT) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000
"""

SQL = {"op1_substring_dedup": OP1, "op6_suffix_dedup": OP6, "op7_knn_join": OP7, "op8_jaccard_join": OP8,
       "op9_contamination": OP9, "op11_merkle_manifest": OP11, "op12_phrase_mining": OP12}
