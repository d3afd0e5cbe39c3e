"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_SPACES = r"[^\x20\x09-\x0D]+"

#: Every window as its words in a row; a window that two places have marks its words.
SUBSTRING = rf"""
WITH words AS (
  SELECT d, generate_subscripts(w, 1) AS i, unnest(w) AS w
  FROM (SELECT row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM docs)),
windows AS (
  SELECT d, i, w, count(*) OVER ahead AS n, string_agg(w, ' ') OVER ahead AS s
  FROM words WINDOW ahead AS (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT s FROM windows WHERE n = 35 GROUP BY s HAVING count(*) > 1),
marked AS (SELECT d, i, w, n = 35 AND r.s IS NOT NULL AS starts FROM windows LEFT JOIN repeated AS r ON windows.s = r.s),
covered AS (
  SELECT d, i, w, bool_or(starts) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (
  SELECT d, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM covered GROUP BY d)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS d, doc_id FROM docs) LEFT JOIN kept USING (d)"""

_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERMS}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.n + 2) // (g.lang_total + 2 * g.v))::BIGINT AS q
  FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10"""

_LEAF = """sha256(concat(
  CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END,
  CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
  CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END,
  CASE WHEN {text} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END))"""

_CRC32 = """
bits AS (SELECT range::BIGINT AS b, range::BIGINT AS c, 0 AS k FROM range(256)),
crc_table AS (
  WITH RECURSIVE t(b, c, k) AS (
    SELECT b, c, 0 FROM bits
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)
  SELECT b, c FROM t WHERE k = 8),
crcs AS (
  WITH RECURSIVE t(s, c, k) AS (
    SELECT DISTINCT doc_id::VARCHAR, 4294967295, 0 FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT t.s, xor(x.c, t.c >> 8), t.k + 1
    FROM t JOIN crc_table AS x ON x.b = xor(t.c, ord(substr(t.s, t.k + 1, 1))) & 255 WHERE t.k < length(t.s))
  SELECT s, xor(c, 4294967295) AS crc FROM t WHERE k = length(s))"""

#: Trees as rows of (level, place): each round makes the nodes above and keeps who is
#: beside whom; then paths and folds go up the same rows. g is null-safe: 0 is a null source.
MERKLE = f"""
WITH RECURSIVE {_CRC32.replace("crc_table AS (", "crc_table AS MATERIALIZED (").replace("crcs AS (", "crcs AS MATERIALIZED (")},
base AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
    {_LEAF.format(text="text")} AS leaf,
    CASE WHEN c.crc % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS start
  FROM documents LEFT JOIN crcs AS c ON c.s = doc_id::VARCHAR),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM base),
nodes(k, g, i, h) AS (
  SELECT 0, g, i, leaf FROM placed
  UNION ALL
  SELECT k + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY k, g, i // 3),
tops AS (SELECT g, max(k) AS k FROM nodes GROUP BY g),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM nodes SEMI JOIN tops USING (g, k)),
crown(k, i, h) AS (
  SELECT 0, i, h FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY k, i // 3),
root AS (SELECT h FROM crown ORDER BY k DESC LIMIT 1),
-- level, place and siblings: those before and those after.
steps AS (
  SELECT k, g, i, coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM nodes ANTI JOIN tops USING (g, k) WINDOW run AS (PARTITION BY k, g, i // 3 ORDER BY i)),
climb(r, k, g, i, f, p) AS (
  SELECT r, 0, g, i, start, '' FROM placed
  UNION ALL
  SELECT c.r, c.k + 1, c.g, c.i // 3, sha256(s.a || c.f || s.b), c.p || s.a || s.b FROM climb AS c JOIN steps AS s ON s.k = c.k AND s.g = c.g AND s.i = c.i),
crown_steps AS (
  SELECT k, i, coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM crown WHERE k < (SELECT max(k) FROM crown) WINDOW run AS (PARTITION BY k, i // 3 ORDER BY i)),
ascend(r, k, i, f, p) AS (
  SELECT r, 0, s.i, f, p FROM climb AS c JOIN tops AS t ON t.g = c.g AND t.k = c.k JOIN subroots AS s ON s.g = c.g
  UNION ALL
  SELECT c.r, c.k + 1, c.i // 3, sha256(s.a || c.f || s.b), c.p || s.a || s.b FROM ascend AS c JOIN crown_steps AS s ON s.k = c.k AND s.i = c.i)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(a.p) AS proof_sha256, a.f AS folded_root, a.f = root.h AS verified
FROM placed JOIN subroots AS s USING (g) JOIN ascend AS a ON a.r = placed.r CROSS JOIN root WHERE a.k = (SELECT max(k) FROM crown)"""

#: Sets of three-word shingles, all pairs that share one, and who is reached by links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACES}') AS w FROM documents)),
three AS (SELECT doc_id, w, n, lead(w, 1) OVER ahead AS w2, lead(w, 2) OVER ahead AS w3 FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i)),
elements AS (
  SELECT DISTINCT doc_id, w || ' ' || w2 || ' ' || w3 AS e FROM three WHERE w3 IS NOT NULL
  UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM words WHERE n < 3 GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM elements AS a JOIN elements AS b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, w.b FROM reached AS r JOIN ways AS w ON w.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, b AS component_id, b = d.doc_id AS kept FROM documents AS d LEFT JOIN sizes USING (doc_id) JOIN least ON a = d.doc_id"""

SQL = {
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op11_substring_dedup": SUBSTRING.replace("FROM docs", "FROM documents"),
    "op12_divergence": DIVERGENCE,
    "op13_merkle": MERKLE,
}
