"""DuckDB SQL of the contracts that SQL can express."""

from __future__ import annotations

from corvane.llm.line_dedup import MIN_CHARS
from corvane.llm.sharding import HASH_BITS, SHARD_BYTES

_SPACED = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
seen AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS k FROM win JOIN seen USING (g) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""

LINE_DEDUP = f"""
WITH l AS MATERIALIZED (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
f AS MATERIALIZED (SELECT line, min((doc_id, i)) AS at FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line),
pairs AS (SELECT a.line AS x, b.line AS y FROM f a JOIN f b ON left(a.line, 15) = left(b.line, 15) AND a.at < b.at UNION SELECT a.line, b.line FROM f a JOIN f b ON right(a.line, 15) = right(b.line, 15) AND a.at < b.at),
near AS (SELECT DISTINCT y AS line FROM pairs WHERE abs(length(x) - length(y)) <= 1 AND levenshtein(x, y) <= 1),
judged AS (SELECT doc_id, l.i, CASE WHEN f.at IS NULL THEN NULL WHEN f.at <> (doc_id, l.i) THEN 'exact' WHEN near.line IS NOT NULL THEN 'near' END AS why FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(j.i)::BIGINT AS n_lines, count(*) FILTER (why = 'exact')::BIGINT AS n_exact, count(*) FILTER (why = 'near')::BIGINT AS n_near, coalesce(string_agg(j.i::VARCHAR, ',' ORDER BY j.i) FILTER (why IS NOT NULL), '') AS removed_lines
FROM documents LEFT JOIN judged j USING (doc_id) GROUP BY doc_id"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r(node, reached) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

SUFFIX_ARRAY = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, substr(hx, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 400 <= length(hx) THEN hash(substr(hx, 2 * i + 1, 400)) END AS win FROM (SELECT doc_id, hx, unnest(generate_series(0, length(hx) // 2 - 1)) AS i FROM h WHERE hx <> '')),
twice AS (SELECT win FROM p WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
c AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN twice.win IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 199, false) AS gone FROM p LEFT JOIN twice USING (win)),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c)
SELECT d.doc_id, count(g.i)::BIGINT AS n_bytes, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (starts)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""

DECONTAMINATION = f"""
WITH iw AS (SELECT item_id::VARCHAR AS item, {_PLAIN.format('text')} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT item, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM (SELECT item, ws, least(13, len(ws)) AS size FROM iw WHERE len(ws) > 0))),
dw AS MATERIALIZED (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS ws FROM documents),
hit AS MATERIALIZED (SELECT doc_id, i, o.size, item FROM (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM dw, (SELECT DISTINCT size FROM win))) o JOIN win ON win.g = o.g AND win.size = o.size),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

SHARDING = f"""
WITH h AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, {HASH_BITS // 4}))::BIGINT), {HASH_BITS}, '0') AS bits FROM documents),
s AS (SELECT doc_id, depth, sum(n_bytes) OVER (PARTITION BY depth, left(bits, depth)) AS size FROM h, (SELECT unnest(generate_series(0, {HASH_BITS})) AS depth)),
d AS (SELECT doc_id, min(depth) AS depth, arg_min(size, depth) AS size FROM s WHERE size <= {SHARD_BYTES} OR depth = {HASH_BITS} GROUP BY doc_id)
SELECT doc_id, n_bytes, left(bits, d.depth) AS shard, d.depth::INTEGER AS depth, size::BIGINT AS shard_bytes FROM h JOIN d USING (doc_id)"""

LEXICAL_SEARCH = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS ws FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
total AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS length FROM d WHERE len(ws) > 0),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
asked AS (SELECT DISTINCT item_id, unnest({_PLAIN.format("coalesce(text, '')")}) AS term FROM benchmark),
each AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS score FROM asked JOIN p USING (term) JOIN w USING (term), total),
summed AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM each GROUP BY item_id, doc_id HAVING sum(score) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM summed) WHERE rank <= 50"""

# DuckDB has no CRC-32: the checksum of an ASCII key, bit by bit.
_BITS = "flatten(list_transform(generate_series(1, length(key)), lambda i: list_transform(generate_series(0, 7), lambda b: ((ascii(key[i]) >> b) & 1)::BIGINT)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_NEXT = "CASE WHEN q = 2 THEN 3 ELSE 2 END"
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hurt AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM (SELECT *, {_CRC} % 20 AS kind FROM src) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS last_role FROM hurt),
t AS MATERIALIZED (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
n AS MATERIALIZED (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last_role IS NOT NULL AND left(last_role, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
step AS MATERIALIZED (SELECT *, fault IN ('fine', 'truncated') AS free, (fault = 'truncated')::INT AS late FROM t),
back(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n, 0, 4, 2, 0 FROM n
  UNION ALL
  SELECT conv_id, i, least(w0, 2 + c2), least(w1, 2 + c2), c2, c3 FROM (SELECT conv_id, i, w0, w1, least(w2, 2 + w3) AS c2, least(w3, 2 + w2) AS c3 FROM (
    SELECT b.conv_id, b.i - 1 AS i,
      least(3 + v0, CASE WHEN free AND r = 's' THEN late + v1 WHEN free AND r = 'u' THEN late + v2 END, CASE WHEN free THEN 2 + late + v2 END) AS w0,
      least(3 + v1, CASE WHEN free AND r = 'u' THEN late + v2 END, CASE WHEN free THEN 2 + late + v2 END) AS w1,
      least(3 + v2, CASE WHEN free AND r = 'a' THEN late + v3 END, CASE WHEN free THEN 2 + late + v3 END) AS w2,
      least(3 + v3, CASE WHEN free AND r = 'u' THEN late + v2 END, CASE WHEN free THEN 2 + late + v2 END) AS w3
    FROM back b JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i))),
v AS MATERIALIZED (SELECT b.conv_id, b.i + 1 AS i, [v0, v1, v2, v3] AS now, s.role, s.text, s.r, s.late, s.free, n.n FROM back b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1),
fwd(conv_id, i, q, audit, made) AS (
  SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM n
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {_NEXT} END, audit || e,
    CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) WHEN 'I' THEN list_append(made, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END) ELSE list_append(made, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || text) END
  FROM (SELECT f.*, v.r, v.role, v.text,
      CASE WHEN v.i <= v.n AND 3 + z.now[q + 1] = v.now[q + 1] THEN 'D'
        WHEN 2 + v.now[{_NEXT} + 1] = v.now[q + 1] THEN 'I'
        WHEN v.i <= v.n AND v.free AND ((q = 0 AND v.r = 's' AND v.late + z.now[2] = v.now[1]) OR (q IN (0, 1, 3) AND v.r = 'u' AND v.late + z.now[3] = v.now[q + 1]) OR (q = 2 AND v.r = 'a' AND v.late + z.now[4] = v.now[3])) THEN 'K'
        WHEN v.i <= v.n THEN 'R' END AS e
    FROM fwd f JOIN v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.i = f.i LEFT JOIN v z ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND z.i = f.i + 1) WHERE e IS NOT NULL),
done AS (SELECT f.conv_id, arg_max(audit, length(audit)) AS audit, arg_max(made, length(audit)) AS made FROM fwd f GROUP BY f.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(v.now[1], 0)::BIGINT AS cost, coalesce(done.audit, '') AS audit, sha256(coalesce(array_to_string(done.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1"""

ORACLE = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_line_dedup": LINE_DEDUP,
    "op4_ngram_jaccard_join": NGRAM_JACCARD,
    "op5_suffix_array_dedup": SUFFIX_ARRAY,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op8_sharding": SHARDING,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_conversation_repair": CONVERSATION_REPAIR,
}
