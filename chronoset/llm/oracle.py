"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '~')) AS k FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM sizes),
weighed AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w, (source_size * 3)::DOUBLE AS cap FROM ranked),
placed AS (SELECT *, row_number() OVER (ORDER BY cap / w, pos) AS place FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM placed),
opened AS (SELECT *, coalesce(min(CASE WHEN cap >= level * w THEN place END) OVER (), 1 << 30) AS open_from FROM levels),
final AS (SELECT *, max(CASE WHEN place = open_from THEN level END) OVER () AS lam FROM opened),
targets AS (SELECT source, source_size, pos, CASE WHEN place < open_from THEN cap ELSE lam * w END AS target FROM final),
queue AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.pos, b.k, (sum(b.size) OVER (PARTITION BY t.pos ORDER BY b.k))::BIGINT AS cum
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.pos, q.k, q.size, (e.e * q.source_size + q.cum)::DOUBLE / q.target AS f
  FROM queue q, (VALUES (0), (1), (2)) e(e) WHERE q.target > 0 AND q.size > 0),
runs AS (SELECT *, sum(size) OVER (ORDER BY f, pos, k) AS run FROM copies),
taken AS (SELECT pos, k, count(DISTINCT f) AS n FROM runs WHERE run <= (SELECT sum(size) FROM base) GROUP BY pos, k)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * CASE WHEN q.size > 0 THEN coalesce(t.n, 0) ELSE 0 END)::BIGINT AS taken
FROM queue q LEFT JOIN taken t ON q.pos = t.pos AND q.k = t.k
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(20 + length(replace(replace(role, '\', '\e'), '<', '\l')) + length(replace(replace(text, '\', '\e'), '<', '\l'))))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score
  FROM c q JOIN c r ON q.d = r.d AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

ORACLE = {"op4_mixing": MIXING, "op5_chat": CHAT, "op6_topk": TOPK}

_CLEAN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_CLEAN}'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format('text')}, '{_CLEAN}') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM runs),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT g.r, g.i, g.n, x.item FROM grams g JOIN runs x ON g.n = x.n AND g.gram = x.gram),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
ORACLE["op9_decontamination"] = DECONTAMINATION

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_CLEAN}'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a),
class AS (SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r),
per AS (SELECT a AS r, count(*) AS n_links, min(d.doc_id) FILTER (equal) AS twin FROM links JOIN d ON d.r = b GROUP BY a)
SELECT d.doc_id, class.class_id, least(d.doc_id, coalesce(per.twin, d.doc_id)) AS copy_id, coalesce(per.n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM d JOIN class USING (r) LEFT JOIN per USING (r) LEFT JOIN n USING (r)
"""
ORACLE["op2_jaccard"] = JACCARD

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(ln)::HUGEINT AS nl FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS ns FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.ns + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (kept.ln + 5)) // (l.nl + 5 * l.v) AS q
  FROM s JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
ORACLE["op12_divergence"] = DIVERGENCE

NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
s AS (SELECT q.r AS qr, x.r AS xr, sum(q.x * x.x)::BIGINT AS score FROM c q JOIN v a ON a.r = q.r AND a.vec_id % 100 = 0 JOIN c x ON q.d = x.d AND q.r <> x.r GROUP BY 1, 2),
n AS (SELECT s.*, a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same FROM s JOIN v a ON a.r = qr JOIN v x ON x.r = xr),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, other_id) AS k FROM n WHERE same) WHERE k <= 5),
f AS (
  SELECT p.qr, p.k, p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.qr, p.k ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM p JOIN n ON n.qr = p.qr AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 10
"""
ORACLE["op13_negatives"] = NEGATIVES

CHOSEN_PATH = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS sh
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, c.component_id IS NULL) AS kept
FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
ORACLE["op11_chosenpath"] = CHOSEN_PATH
