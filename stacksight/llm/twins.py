"""DuckDB twins of operators that plain SQL can state: op1, op6, op8, op11 and op13, over their whole tables."""

#: Texts as hex digits, two a byte; strings of 200 bytes are told by MD5. Texts are cut into parts first, as a substring costs as much as what lies before it.
OP1 = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2, 256)) AS before FROM bytes),
cut AS MATERIALIZED (SELECT doc_id, before, substr(h, 2 * before + 1, 910) AS h FROM parts),
places AS (SELECT doc_id, before, h, unnest(range(1, least(256, strlen(h) // 2) + 1)) AS k FROM cut),
strings AS (
  SELECT doc_id, before + k AS place, substr(h, 2 * k - 1, 2) AS byte,
    CASE WHEN 2 * k + 398 <= strlen(h) THEN md5_number(substr(h, 2 * k - 1, 400)) END AS string
  FROM places),
repeated AS (SELECT string FROM strings WHERE string IS NOT NULL GROUP BY string HAVING count(*) > 1),
starts AS (
  SELECT s.doc_id, s.place, s.byte, r.string IS NOT NULL AS again
  FROM strings s LEFT JOIN repeated r ON s.string = r.string),
covered AS (
  SELECT doc_id, place, byte,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM starts),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), false) AS opens FROM covered),
found AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    string_agg(byte, '' ORDER BY place) FILTER (NOT gone) AS kept
  FROM edges GROUP BY doc_id)
SELECT b.doc_id, CAST(strlen(b.h) // 2 AS BIGINT) AS n_bytes, coalesce(f.n_removed, 0) AS n_removed,
  coalesce(f.n_spans, 0) AS n_spans, sha256(unhex(coalesce(f.kept, ''))) AS kept_sha256
FROM bytes b LEFT JOIN found f ON b.doc_id = f.doc_id
"""

#: Links from an inverted index of all shingles; components by reaching out from every document.
OP6 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place, len(words) AS n FROM texts),
pairs AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY place) AS next, n FROM words),
shingles AS (SELECT DISTINCT doc_id, concat_ws(' ', word, next) AS shingle FROM pairs WHERE next IS NOT NULL OR n = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN smallest m ON d.doc_id = m.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

#: Windows of 13 words, each with the smallest document that it starts in.
OP8 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
windows AS (
  SELECT doc_id, place, word, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS words
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT words, min(doc_id) AS doc_id FROM windows WHERE n = 13 GROUP BY words),
starts AS (
  SELECT w.doc_id, w.place, w.word, f.words IS NOT NULL AS again
  FROM windows w LEFT JOIN firsts f ON w.n = 13 AND w.words = f.words AND f.doc_id < w.doc_id),
covered AS (
  SELECT doc_id, place, word,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM starts),
found AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(f.n_removed, 0) AS n_removed, sha256(coalesce(f.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id
"""

_P = lambda n, total: f"(1 + 1000000000::HUGEINT * ({n} + 2) // ({total} + 2 * terms))"
_F = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"

#: Every kept term of every group and of every pair of groups is laid out.
OP11 = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
found AS (SELECT lang, source, d, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS terms, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P('coalesce(c.n, 0)', 'g.total')} AS p, {_P('k.n', 'l.total')} AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum({_F('a.p', 'b.p')}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, {_F('p', 'q')} FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""


def _rounds() -> str:
    """Four assignments, and the three moves of the centroids between them."""
    squares = "list_sum(list_transform(list_zip(v.point, c.point), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    out = ["c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, point FROM points ORDER BY sha256('1:' || vec_id) LIMIT 16)"]
    for r in range(4):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.point, min(struct_pack(d := ({squares})::BIGINT, k := c.k)) AS best FROM points v, c{r} c GROUP BY ALL)")
        if r < 3:
            out.append(f"s{r} AS (SELECT best.k AS k, i, sum(point[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY ALL)")
            out.append(f"m{r} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS point FROM s{r} GROUP BY k)")
            out.append(f"c{r + 1} AS (SELECT c.k, coalesce(m.point, c.point) AS point FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)")
    return ",\n".join(out)


OP13 = f"""
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS point FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
{_rounds()}
SELECT a.vec_id, best.k::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.point, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.k = a.best.k
"""
