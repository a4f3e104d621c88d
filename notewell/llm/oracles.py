"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LINE_TEMPLATES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  m AS (SELECT doc_id, line, regexp_replace(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
  t AS (SELECT *, string_split(masked, ' ') AS tokens FROM m WHERE masked <> '' AND len(string_split(masked, ' ')) >= 3),
  u AS (SELECT *, len(tokens) || ':' || array_to_string(tokens[1:3], ' ') AS leaf FROM t),
  known AS (SELECT masked FROM u GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
  rest AS (SELECT * FROM u WHERE masked NOT IN (SELECT masked FROM known)),
  leaves AS (SELECT leaf FROM rest GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
  inside AS (SELECT * FROM rest WHERE leaf IN (SELECT leaf FROM leaves)),
  variants AS (SELECT leaf, masked, tokens, count(DISTINCT doc_id) AS docs FROM inside GROUP BY ALL),
  tok AS (SELECT leaf, masked, docs, len(tokens) AS size, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS tok FROM variants),
  cnt AS (SELECT leaf, pos, tok, count(*) AS c, sum(docs) AS d FROM tok GROUP BY ALL),
  best AS (SELECT *, sum(c) OVER (PARTITION BY leaf, pos) AS s, row_number() OVER (PARTITION BY leaf, pos ORDER BY c DESC, tok DESC) AS r FROM cnt),
  const AS (SELECT leaf, pos, tok FROM best WHERE r = 1 AND 2 * c >= s AND tok <> '<*>'),
  size AS (SELECT leaf, count(*) AS n FROM best WHERE r = 1 GROUP BY 1),
  tpl AS (SELECT leaf FROM const JOIN size USING (leaf) GROUP BY leaf, n HAVING 2 * count(*) >= n),
  wrong AS (SELECT DISTINCT i.doc_id, i.line FROM inside i JOIN const c ON c.leaf = i.leaf WHERE i.tokens[c.pos] <> c.tok),
  fits AS (SELECT doc_id, line, leaf FROM inside i WHERE leaf IN (SELECT leaf FROM tpl)
    AND NOT EXISTS (SELECT 1 FROM wrong w WHERE w.doc_id = i.doc_id AND w.line = i.line)),
  again AS (SELECT leaf FROM fits GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
  often AS (SELECT leaf, pos, tok FROM cnt WHERE d >= 10 AND tok <> '<*>'),
  shape AS (SELECT leaf, masked, string_agg(pos || ' ' || tok, ' ' ORDER BY pos) AS shape FROM tok JOIN often USING (leaf, pos, tok)
    GROUP BY leaf, masked, size HAVING 2 * count(*) >= size),
  alike AS (SELECT doc_id, line, leaf, shape FROM inside JOIN shape USING (leaf, masked)),
  shapes AS (SELECT leaf, shape FROM alike GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
  gone AS (SELECT doc_id, line FROM u WHERE masked IN (SELECT masked FROM known) UNION SELECT doc_id, line FROM fits WHERE leaf IN (SELECT leaf FROM again)
    UNION SELECT doc_id, line FROM alike JOIN shapes USING (leaf, shape)),
  per AS (SELECT doc_id, list(line) AS g FROM gone GROUP BY 1),
  k AS (SELECT d.doc_id, string_split(text, chr(10)) AS a,
    list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(g, x), false)) AS b FROM documents d LEFT JOIN per USING (doc_id))
SELECT doc_id, len(a) AS n_lines, len(a) - len(b) AS n_dropped, length(array_to_string(b, chr(10))) AS kept_chars, md5(array_to_string(b, chr(10))) AS kept_md5 FROM k
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
    FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs WHERE 100 * i >= 90 * (na + nb - i)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id FROM s JOIN least USING (doc_id)
"""


def _dealt(rows: str, parent: str, name: str, given: str, out: str) -> str:
    """Children of each parent in the order of cap / w; those that an equal rate over all later ones would fill are full."""
    by = f"PARTITION BY {parent}" if parent else ""
    before = f"({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT *, CASE WHEN f THEN cap ELSE (w * ({given} - coalesce(sum(cap) FILTER (f) OVER ({by}), 0)))
        // greatest(sum(w) OVER ({by}) - coalesce(sum(w) FILTER (f) OVER ({by}), 0), 1) END AS {out}
      FROM (SELECT *, cap * (sum(w) OVER ({by}) - coalesce(sum(w) OVER {before}, 0)) <= w * ({given} - coalesce(sum(cap) OVER {before}, 0)) AS f FROM ({rows}))"""


MIX = f"""
WITH n AS (SELECT doc_id, 'd' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) // 4) AS d,
    coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n FROM documents),
  leaf AS (SELECT d, l, s, sum(n) AS tokens, 4 * sum(n) AS cap FROM n GROUP BY ALL),
  dd AS ({_dealt("""SELECT d, sum(cap) AS cap, CASE d WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
      (SELECT least(sum(tokens) * 3 // 5, sum(cap)) FROM leaf) AS given FROM leaf GROUP BY d""", "", "d", "given", "dq")}),
  ll AS ({_dealt("""SELECT leaf.d, l, sum(leaf.cap) AS cap, any_value(dq) AS dq, CASE l WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w
      FROM leaf JOIN dd ON dd.d = leaf.d GROUP BY leaf.d, l""", "d", "l", "dq", "lq")}),
  ss AS ({_dealt("SELECT leaf.d, leaf.l, s, tokens, leaf.cap, lq, 1 AS w FROM leaf JOIN ll ON ll.d = leaf.d AND ll.l = leaf.l", "d, l", "s", "lq", "q")}),
  e AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN q // tokens ELSE 0 END AS epochs, q - CASE WHEN tokens > 0 THEN q // tokens ELSE 0 END * tokens AS rest FROM ss),
  h AS (SELECT n.*, epochs, rest, md5('mix-1:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM n JOIN e ON n.d = e.d AND n.l = e.l AND n.s = e.s),
  c AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY h, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h),
  k AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)
SELECT doc_id, d AS domain, l AS lang, s AS source, n AS n_tokens, copies FROM k WHERE copies > 0
"""

EXACT = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256 FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

# crc32 by its definition, bit by bit: bytes are numbers of 0 to 255, -1 is a shift.
CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

TRIE = f"""
WITH c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT *, {CRC32} % 6 AS h FROM c),
  s AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
  p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM s),
  n AS (SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
  kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
  v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.k[depth].t) ELSE 0 END AS saved
    FROM n LEFT JOIN kids ON kids.k = n.k),
  up AS (SELECT k[1:d] AS k, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v)),
  sums AS (SELECT k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN sums ON sums.k = v.k LEFT JOIN n p ON v.depth > 0 AND p.k = v.k[1:v.depth - 1]
"""

ORACLE_SQL = {"op1_line_templates": LINE_TEMPLATES, "op5_mix_sources": MIX, "op6_ngram_jaccard": JACCARD, "op11_exact_dedup": EXACT, "op13_conversation_trie": TRIE}
