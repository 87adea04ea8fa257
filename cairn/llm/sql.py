"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Containment of at least 0.8 of an item's distinct five-word shingles (of all its words, if fewer).
OP1 = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
doc_shingles AS (SELECT DISTINCT rid, doc_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
hits AS (SELECT rid, doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment FROM hits JOIN sizes USING (item_id) WHERE 10 * n_found >= 8 * n
"""

OP7 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.rid, l.pos, l.line, b.line IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first AS gone FROM l LEFT JOIN b ON l.line = b.line),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN g.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN g USING (rid)
"""

OP11 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
u AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, list_transform([1, 9, 17, 25], lambda i: ('0x' || hex[i:i + 7])::BIGINT) AS h FROM d),
c AS (SELECT *, len(lines) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(lines[:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

_TERMS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM benchmark),
want AS (SELECT DISTINCT iid, item_id, unnest(w) AS term FROM i),
size AS (SELECT rid, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM size),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM want) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
hit AS (SELECT rid, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS part FROM tf JOIN size USING (rid) JOIN weight USING (term), total),
score AS (SELECT iid, item_id, rid, doc_id, sum(part)::BIGINT AS score FROM want JOIN hit USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM score QUALIFY rank <= 10
"""

ORACLES = {"op1_decontaminate": OP1, "op7_line_spread": OP7, "op11_fim": OP11, "op12_lexical": OP12}
