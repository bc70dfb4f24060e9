"""DuckDB statements for the queries that SQL can express."""
from __future__ import annotations

from inswing.llm.quality import CATCH, DELTA, MIN_WORDS, PATH, REPEAT_PERCENT, RISK

ORACLE: dict[str, str] = {}

ORACLE["op3_decontamination"] = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
size AS (SELECT DISTINCT least(len(w), 5) AS k FROM item WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, rid, array_to_string(w[i:i + k - 1], ' ') AS g FROM doc, size, unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM item, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM ig GROUP BY item_id),
s AS (SELECT doc_id, rid, item_id, item_shingles, count(*) AS shared FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= 0.8 * item_shingles)
SELECT doc_id, item_id, item_shingles, max(shared) AS shared, max(shared) / item_shingles AS containment FROM s GROUP BY doc_id, item_id, item_shingles
"""

ORACLE["op6_chat_formatting"] = r"""
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS rid, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id, rid),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, ts FROM c GROUP BY ts),
p AS (SELECT DISTINCT ts[1:k] AS ts FROM c, unnest(generate_series(1, len(ts) - 1)) AS u(k))
SELECT conv_id, len(ts) AS n_turns, copies, array_to_string(list_transform(ts, lambda x:
  '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = w.ts)
"""

ORACLE["op8_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM f
"""

ORACLE["op9_line_dedup"] = r"""
WITH s AS (SELECT doc_id, row_number() OVER () AS rid, length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lead,
      regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ps FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, rid, lead, i, length(ps[i]) AS size, lower(regexp_extract(ps[i], '[^\x20\x09-\x0D]+')) AS w, length(regexp_extract(ps[i], '[^\x20\x09-\x0D]+')) AS chars
      FROM s, unnest(generate_series(1, len(ps))) AS t(i)),
o AS (SELECT *, lead + sum(size) OVER p - size AS pos, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?,;:r]$') THEN 1 ELSE 0 END)
      OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM l WINDOW p AS (PARTITION BY rid ORDER BY i)),
g0 AS (SELECT doc_id, rid, unit, min(pos) AS start, max(pos + chars) AS "end", string_agg(w, ' ' ORDER BY i) AS norm, count(*) AS n FROM o GROUP BY ALL),
u AS (SELECT doc_id, rid, unit AS i, start, "end", norm, sum(n) OVER p - n AS before, sum(n) OVER p AS upto FROM g0 WINDOW p AS (PARTITION BY rid ORDER BY unit)),
e AS (SELECT a.doc_id, a.rid, a.i AS a, a.start, a.before, min(b.i) AS b FROM u a JOIN u b ON a.rid = b.rid AND b.i BETWEEN a.i AND a.i + 19 AND b.upto - a.before >= 20 GROUP BY ALL),
r AS (SELECT e.doc_id, e.rid, e.a, e.b, e.start, e.before, max(u."end") AS "end", max(u.upto) AS upto, string_agg(u.norm, chr(10) ORDER BY u.i) AS run
      FROM e JOIN u ON u.rid = e.rid AND u.i BETWEEN e.a AND e.b GROUP BY ALL),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY run) AS holder, first_value(b) OVER (PARTITION BY rid, run ORDER BY a) < a AS again FROM r),
g AS (SELECT *, max(upto) OVER (PARTITION BY rid ORDER BY before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f WHERE again OR doc_id <> holder),
h AS (SELECT *, sum(CASE WHEN reached IS NULL OR before > reached THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY before) AS island FROM g)
SELECT any_value(doc_id) AS doc_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", (max(upto) - min(before))::BIGINT AS n_words, min(holder) AS kept_doc_id
FROM h GROUP BY rid, island HAVING max(upto) - min(before) >= 30
"""

_PATH = ", ".join(f"({step}, {r}, {c})" for step, cutoffs in enumerate(PATH) for r, c in enumerate(cutoffs))

ORACLE["op1_quality_rules"] = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, i, w[i:i + 2] AS g FROM w, unnest(generate_series(1, len(w) - 2)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM r, unnest([i, i + 1, i + 2]) AS u(p) GROUP BY rid),
b AS (SELECT w.rid, w.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, [
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END,
  CASE WHEN n_words > 0 THEN 1 - n_distinct / n_words ELSE 0 END] AS scores FROM b),
s AS (SELECT rid, doc_id, coalesce(lang, chr(0)) AS lang, base_failed, rule, scores[rule + 1] AS score FROM f, unnest(generate_series(0, {len(PATH[0]) - 1})) AS u(rule)),
path(step, rule, cutoff) AS (VALUES {_PATH}),
known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang, rid, good, step, bool_or(score > cutoff) AS over FROM s JOIN known USING (doc_id) JOIN path USING (rule) WHERE NOT base_failed GROUP BY lang, rid, good, step),
k AS (SELECT lang, step, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND over) AS k, count(*) FILTER (WHERE NOT good AND over) AS caught FROM held GROUP BY lang, step),
p AS (SELECT lang, step, k.k, k.n, caught, sum(exp(lgamma(k.n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN k.n > i THEN lgamma(k.n - i + 1) ELSE 0 END
  + i * ln({RISK}) + (k.n - i) * ln(1 - {RISK}))) AS tail FROM k, unnest(generate_series(0, k.k)) AS u(i) WHERE k.n > 0 AND k.k < k.n * {RISK} GROUP BY lang, step, k.k, k.n, caught),
sure AS (SELECT *, max(caught) OVER (PARTITION BY lang) AS most FROM p WHERE tail <= {DELTA} / (SELECT greatest(1, count(DISTINCT lang)) FROM held WHERE good)),
chosen AS (SELECT lang, min(step) AS step FROM sure WHERE caught >= {CATCH} * most GROUP BY lang),
bad AS (SELECT DISTINCT rid FROM s JOIN chosen USING (lang) JOIN path USING (step, rule) WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.rid = f.rid) AS kept FROM f
"""

ORACLE["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
none AS (SELECT doc_id FROM w WHERE len(w) = 0),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)
  UNION ALL SELECT x.doc_id, y.doc_id FROM none x JOIN none y ON x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
SELECT a AS doc_id, min(b) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM reach LEFT JOIN k ON k.doc_id = a GROUP BY a
"""

ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
df AS (SELECT lang, term, count(*) AS docs FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) JOIN df USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
sz AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
lsz AS (SELECT lang, sum(n) AS size FROM c GROUP BY lang),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(sz.size, 0) + v.v) AS p
    FROM grp g JOIN v USING (lang) JOIN df t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term LEFT JOIN sz ON sz.lang = g.lang AND sz.source = g.source),
q AS (SELECT lt.lang, lt.term, 1 + (1000000000::HUGEINT * (lt.n + 1)) // (lsz.size + v.v) AS q FROM lt JOIN lsz USING (lang) JOIN v USING (lang)),
val AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(val.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN val ON val.lang = a.lang AND val.source = a.source AND val.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE["op13_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
s AS (SELECT doc_id, text, n,
    array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM s
"""
