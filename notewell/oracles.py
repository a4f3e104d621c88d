"""DuckDB SQL for the queries of `queries`, written independently of the Spark plans."""

from __future__ import annotations

NOTE = """note AS (
  SELECT d.doc_id, d.source || '/' || d.lang || '/' || d.doc_id || '.md' AS relative_path, 'doc ' || d.doc_id AS title,
    d.text AS content, d.lang, d.source,
    CASE WHEN d.doc_id % 7 = 0 THEN [d.lang, d.source, 'daily'] ELSE [d.lang, d.source] END AS tags,
    CASE WHEN l.toxic = 1 THEN 'hidden' WHEN l.quality = 0 THEN 'inactive' WHEN l.doc_id IS NOT NULL THEN 'active' END AS status,
    e.ts AS modified, v.embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
    LEFT JOIN embeddings v ON v.vec_id = d.doc_id)"""
COS0 = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
SIM = f"sim AS (SELECT *, {COS0} AS similarity FROM note WHERE embedding IS NOT NULL)"


def near(k: int, source: str = "sim", name: str = "near") -> str:
    return f"{name} AS (SELECT * FROM {source} ORDER BY round(similarity, 9) DESC, doc_id LIMIT {k})"


WORDS = "['the', 'thing', 'src7', 'ily']"
INDEX_TEXT = "concat_ws(' ', title, array_to_string(list_concat(tags, tags), ' '), content)"


def bm25(tags: str = "tags") -> str:
    text = f"concat_ws(' ', title, {'array_to_string(list_concat(tags, tags), chr(32))' if tags == 'tags' else chr(39) * 2}, content)"
    return rf"""
  words AS (SELECT doc_id, list_filter(string_split_regex(lower({text}), '\s+'), lambda x: x <> '') AS w FROM note),
  corpus0 AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM words),
  postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
  raw_terms AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus0),
  corpus AS (SELECT n_docs, avgdl, (SELECT avg(idf) FROM raw_terms) AS avg_idf FROM corpus0),
  terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * avg_idf ELSE idf END AS idf FROM raw_terms, corpus),
  bm AS (SELECT p.doc_id, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(w.w) / c.avgdl))) AS bm25
    FROM postings p JOIN terms t USING (term) JOIN words w USING (doc_id), corpus c
    WHERE list_contains({WORDS}, p.term) GROUP BY p.doc_id)"""


MATCHED = f"""CASE WHEN len(list_intersect(tags, {WORDS})) > 0 THEN list_sort(list_intersect(tags, {WORDS}))
  ELSE list_sort(list_distinct(flatten(list_transform({WORDS},
    lambda q: list_filter(tags, lambda t: contains(t, q) OR contains(q, t))[1:1])))) END"""


def keyword(k: int, where: str = "true", tags: str = "tags") -> str:
    own = MATCHED if tags == "tags" else "[]::VARCHAR[]"
    return f"""
  hits AS (SELECT n.doc_id, relative_path, bm25 AS bm25_base, {own} AS matched FROM bm JOIN note n USING (doc_id) WHERE bm25 > 0 AND {where}),
  kw AS (SELECT *, CASE WHEN len(matched) > 0 THEN bm25_base * 5.0 ELSE bm25_base END AS bm25 FROM hits
    ORDER BY round(bm25, 9) DESC, doc_id LIMIT {k})"""


def hybrid(limit: int, tags: str = "tags") -> str:
    return f"""WITH {NOTE}, {SIM}, {near(3 * limit)}, {bm25(tags)}, {keyword(3 * limit, tags=tags)},
  s AS (SELECT doc_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, doc_id) AS s_rank FROM near),
  k AS (SELECT doc_id, bm25, matched, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS k_rank FROM kw),
  f0 AS (SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, s_rank, k_rank, bm25, matched,
    coalesce(1.0 / (60 + s_rank), 0) + coalesce(1.0 / (60 + k_rank), 0) AS rrf0 FROM s FULL JOIN k ON s.doc_id = k.doc_id),
  f1 AS (SELECT *, max(rrf0) OVER () AS m, bm25 / max(bm25) OVER () AS share,
    coalesce(k_rank <= 10 AND len(matched) > 0, false) AS tag_boosted FROM f0),
  f2 AS (SELECT *, CASE WHEN tag_boosted THEN m * (1.5 + 0.5 * share)
    WHEN k_rank <= 10 AND s_rank IS NULL THEN m * 0.95 * share ELSE rrf0 END AS rrf FROM f1),
  f AS (SELECT * FROM f2 ORDER BY round(rrf, 9) DESC, doc_id LIMIT {limit}),
  found AS (SELECT f.doc_id, relative_path, rrf, tag_boosted, matched, s_rank,
    coalesce({COS0}, 0.0) AS similarity, coalesce(f.bm25, 0.0) AS bm25 FROM f JOIN note n USING (doc_id))"""


CHUNKS = """counted AS (SELECT *, length(content) AS n, CASE WHEN length(content) < 4000 THEN 1
    ELSE greatest(1, CAST(floor((length(content) - 1000) / 1600.0) AS INTEGER) + 1) END AS chunk_total FROM base WHERE trim(content) <> ''),
  placed AS (SELECT *, unnest(range(0, chunk_total)) AS chunk_index FROM counted),
  bounds AS (SELECT *, chunk_index * 1600 AS chunk_start,
    CASE WHEN chunk_index = chunk_total - 1 THEN n ELSE least(chunk_index * 1600 + 2000, n) END AS chunk_end FROM placed),
  chunks AS (SELECT * REPLACE (substr(content, chunk_start + 1, chunk_end - chunk_start) AS content) FROM bounds)"""
BASE = "base AS (SELECT doc_id, text AS content FROM documents)"
SCORED_CHUNKS = f"""WITH {NOTE}, base AS (SELECT doc_id, relative_path, content FROM note), {CHUNKS},
  scored AS (SELECT *, len(regexp_extract_all(lower(content), 'the ')) / length(content) AS score FROM chunks)"""
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
DAYS = f"floor((epoch({NOW}) - epoch(modified)) / 86400)"
BOOST = f"(1 + 0.2 * pow(0.5, {DAYS} / 90))"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def cleaned(t: str) -> str:
    for pattern, put in (
        (r"\[\[([^\]]+)\]\]", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"#+\s*", ""), (r"\*\*([^*]+)\*\*", r"\1"),
        (r"\*([^*]+)\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"\n+", " "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return f"trim({t}, {BLANKS})"


STOPS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he "
    "her here his how i if in into is it its just like me more most my no not of on only or other our out over she so "
    "some such than that the their them then there these they this to up was we were what when where which who will "
    "with would you your"
).split()
MARKED = """replace(replace(replace(replace(text, ' the ', ' **the** '), ' and ', ' [[and]] '), ' of ', ' [of](http://x/' || doc_id || ') '),
  ' in ', ' `in` #in-' || doc_id % 5 || ' ')"""
DRESSED = f"""'# ' || {MARKED} || chr(10) || chr(10) || '[[note ' || doc_id || ']] *x* `c`' || chr(10) || '#tag' || doc_id % 5 || ' #b-' || doc_id % 3"""
MD = f"md AS (SELECT doc_id, {DRESSED} AS t FROM documents)"
DATED = f"""WITH {NOTE}, {SIM}, {near(50)},
  entries AS (SELECT *, DATE '2022-01-01' + CAST(doc_id * 37 % 730 AS INTEGER) AS date FROM near
    WHERE similarity >= 0.05 AND NOT list_contains(tags, 'daily')),
  months AS (SELECT strftime(date, '%Y-%m') AS month, avg(similarity) AS intensity, count(*) AS activity FROM entries GROUP BY 1)"""
LOG = """log AS (SELECT event_id AS id, ts, nullif(event_type, 'view') AS mode, value AS total_ms, value / 2 AS retrieval_ms,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""
PATHS = """paths AS (SELECT CASE doc_id % 8 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Reference/Tech' WHEN 2 THEN 'Reference/Culture' WHEN 3 THEN 'L'
    WHEN 4 THEN 'Reference/Other' WHEN 5 THEN '.trash' WHEN 6 THEN 'Utilities' ELSE 'node_modules/x' END
    || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || CASE WHEN doc_id % 11 = 0 THEN '.pdf' ELSE '.md' END AS relative_path FROM documents),
  notes AS (SELECT * FROM paths WHERE relative_path LIKE '%.md' AND NOT regexp_matches(relative_path, '^(\\.|Utilities|node_modules)'))"""
CHANGES = f"""WITH {NOTE},
  now AS (SELECT relative_path, content, doc_id, CASE WHEN doc_id % 10 = 3 THEN modified + INTERVAL 1 SECOND ELSE modified END AS modified
    FROM note WHERE doc_id % 10 <> 1),
  old AS (SELECT relative_path, content, doc_id, modified FROM note WHERE doc_id % 10 <> 2),
  changes AS (SELECT coalesce(n.relative_path, o.relative_path) AS relative_path,
    CASE WHEN o.relative_path IS NULL THEN 'new' WHEN n.relative_path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
    FROM now n FULL JOIN old o ON n.relative_path = o.relative_path
    WHERE o.relative_path IS NULL OR n.relative_path IS NULL OR n.modified IS DISTINCT FROM o.modified)"""
PIPE = f"""WITH {NOTE}, {SIM}, {near(60)},
  a AS (SELECT * FROM near WHERE similarity >= 0.05),
  b AS (SELECT * FROM a WHERE coalesce(status, 'active') NOT IN ('inactive', 'hidden')),
  c AS (SELECT * FROM b WHERE lang IN ('en', 'de') AND NOT list_contains(tags, 'daily') AND NOT contains(relative_path, 'src13/')),
  d AS (SELECT *, similarity * coalesce({BOOST}, 1.0) AS boosted FROM c),
  e AS (SELECT * FROM d ORDER BY round(boosted, 9) DESC, doc_id LIMIT 10)"""


def _only(cond: str) -> str:
    return f"WITH {NOTE} SELECT doc_id FROM note WHERE {cond}"


DESCRIBED = """CASE WHEN length(c) <= 150 THEN c
  WHEN contains(h, '.') THEN CASE WHEN 151 - strpos(reverse(h), '.') > 76 THEN substr(c, 1, 151 - strpos(reverse(h), '.')) ELSE '' END
  WHEN contains(h, ' ') THEN substr(c, 1, 150 - strpos(reverse(h), ' ')) || '...' ELSE h || '...' END"""

# The model of word pairs: texts cut for judged pairs, their bins, and the log odds of these.
def _pair_bins(q: str, t: str) -> str:
    two = lambda x: f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
    at = f"list_min(list_filter(list_transform({q}, lambda x: list_position({t}, x)), lambda k: k > 0))"
    return f"""4 * len(list_intersect({q}, {t})) // greatest(1, len(list_distinct({q}))) AS coverage,
      4 * len(list_intersect({two(q)}, {two(t)})) // greatest(1, len(list_distinct({two(q)}))) AS phrases,
      coalesce(4 * ({at} - 1) // len({t}), 4) AS start"""


PAIR_MODEL = rf"""dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
  asked AS (SELECT doc_id, w, doc_id % (len(w) - 4) AS s FROM dw WHERE len(w) >= 10 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
  pairs AS (SELECT w[s + 1:s + 5] AS q, list_concat(w[1:s], w[s + 6:len(w)]) AS t, true AS y FROM asked
    UNION ALL SELECT a.w[a.s + 1:a.s + 5], b.w, false FROM asked a JOIN dw b ON b.doc_id = a.doc_id + 1),
  bins AS (SELECT y, {_pair_bins('q', 't')} FROM pairs),
  long AS (SELECT 'coverage' AS feature, coverage AS bin, y FROM bins UNION ALL SELECT 'phrases', phrases, y FROM bins UNION ALL SELECT 'start', start, y FROM bins),
  total AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM bins),
  grid AS (SELECT f.feature, b.bin FROM (SELECT unnest(['coverage', 'phrases', 'start']) AS feature) f, (SELECT unnest(range(5)) AS bin) b),
  model AS (SELECT g.feature, g.bin, ln((count(*) FILTER (l.y) + 1) / (any_value(p) + 5)) - ln((count(*) FILTER (NOT l.y) + 1) / (any_value(n) + 5)) AS weight
    FROM grid g CROSS JOIN total LEFT JOIN long l ON l.feature = g.feature AND l.bin = g.bin GROUP BY 1, 2)"""


ORACLE_SQL: dict[str, str] = {
    "cosine_pairs": """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine
      FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "semantic_topk": f"WITH {NOTE}, {SIM}, {near(20)} SELECT doc_id, round(similarity, 6) AS similarity FROM near",
    "semantic_search": f"""WITH {NOTE}, {SIM}, {near(10)}, t AS (SELECT *, trim(content, {BLANKS}) AS c, substr(trim(content, {BLANKS}), 1, 150) AS h FROM near)
      SELECT doc_id, relative_path, title, round(similarity, 6) AS similarity, {DESCRIBED} AS description, '[[' || title || ']]' AS wiki_link FROM t""",
    "prefilter_semi": f"""WITH {NOTE}, {SIM},
      part AS (SELECT * FROM sim WHERE contains(relative_path, 'src7/') OR contains(relative_path, 'src1/')), {near(10, 'part')}
      SELECT doc_id, round(similarity, 6) AS similarity FROM near""",
    "bm25_index_text": f"WITH {NOTE} SELECT doc_id, md5({INDEX_TEXT}) AS text_md5 FROM note",
    "bm25_corpus_stats": f"""WITH {NOTE}, {bm25()} SELECT n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf,
      (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM postings) AS postings FROM corpus""",
    "bm25_scores": f"WITH {NOTE}, {bm25()} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_search": f"""WITH {NOTE}, {bm25()}, {keyword(10)}
      SELECT doc_id, relative_path, round(bm25, 6) AS bm25, round(bm25_base, 6) AS bm25_base FROM kw""",
    "bm25_tag_boost": f"""WITH {NOTE}, m AS (SELECT doc_id, {MATCHED} AS matched FROM note)
      SELECT doc_id, array_to_string(matched, ',') AS tags_matched, CASE WHEN len(matched) > 0 THEN 7.5 ELSE 1.5 END::DOUBLE AS bm25 FROM m""",
    "bm25_prefilter": f"""WITH {NOTE}, {bm25()}, {keyword(10, "contains(relative_path, 'src3/')")}
      SELECT doc_id, round(bm25, 6) AS bm25 FROM kw""",
    "rrf_fusion": f"""WITH {NOTE}, {SIM}, {near(30)}, {bm25()}, {keyword(30)},
      u AS (SELECT doc_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, doc_id) AS r FROM near UNION ALL
        SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) FROM kw),
      f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS rrf FROM u GROUP BY 1)
      SELECT doc_id, round(rrf, 9) AS rrf FROM f ORDER BY round(rrf, 9) DESC, doc_id LIMIT 20""",
    "hybrid_search": hybrid(10) + " SELECT doc_id, relative_path, round(rrf, 9) AS rrf, round(similarity, 6) AS similarity, round(bm25, 6) AS bm25, tag_boosted FROM found",
    "hybrid_tag_boost": hybrid(30) + " SELECT doc_id, round(rrf, 9) AS rrf, array_to_string(matched, ',') AS tags_matched FROM found WHERE tag_boosted",
    "hybrid_keyword_boost": hybrid(30, "none") + " SELECT doc_id, round(rrf, 9) AS rrf, round(bm25, 6) AS bm25 FROM found WHERE s_rank IS NULL",
    "dedup_best": SCORED_CHUNKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY round(score, 9) DESC, chunk_index) AS k,
        count(*) OVER (PARTITION BY relative_path) AS matched_chunks FROM scored)
      SELECT relative_path, chunk_index AS best_chunk_index, matched_chunks, chunk_total, round(score, 6) AS score FROM r WHERE k = 1""",
    "dedup_all": SCORED_CHUNKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY round(score, 9) DESC, chunk_index) AS file_rank FROM scored)
      SELECT relative_path, chunk_index, file_rank, round(score, 6) AS score FROM r WHERE file_rank <= 2""",
    "expand_gate": r"SELECT item_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) < 3 AS expands FROM benchmark",
    "pair_model_weights": f"WITH {PAIR_MODEL} SELECT feature, bin::INT AS bin, round(weight, 6) AS weight FROM model",
    "pair_rerank": rf"""WITH {NOTE}, {SIM}, {near(40)}, {PAIR_MODEL}, first AS (SELECT * FROM near ORDER BY round(similarity, 9) DESC, doc_id LIMIT 30),
      c AS (SELECT doc_id, {WORDS} AS q, list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '') AS t FROM first),
      cb AS (SELECT doc_id, {_pair_bins('q', 't')} FROM c),
      s AS (SELECT doc_id, 1 / (1 + exp(-((SELECT weight FROM model WHERE feature = 'coverage' AND bin = coverage)
        + (SELECT weight FROM model WHERE feature = 'phrases' AND bin = phrases) + (SELECT weight FROM model WHERE feature = 'start' AND bin = start)))) AS x FROM cb)
      SELECT doc_id, round(x, 6) AS cross_encoder FROM s ORDER BY round(x, 9) DESC, doc_id LIMIT 10""",
    "time_boost": f"""WITH {NOTE}, {SIM}, {near(40)} SELECT doc_id, round(similarity * coalesce({BOOST}, 1.0), 6) AS similarity,
      round(coalesce({BOOST}, 1.0), 6) AS time_boost, round(similarity, 6) AS original_score FROM near""",
    "rerank_topk": rf"""WITH {NOTE}, {SIM}, {near(40)}, first AS (SELECT * FROM near ORDER BY round(similarity, 9) DESC, doc_id LIMIT 30),
      w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '')) AS own FROM first),
      s AS (SELECT doc_id, len(list_intersect(own, {WORDS})) / 4.0 + len(list_intersect(own, {WORDS})) / len(own) AS x FROM w)
      SELECT doc_id, round(x, 6) AS cross_encoder FROM s ORDER BY round(x, 9) DESC, doc_id LIMIT 10""",
    "pipeline_default": PIPE + " SELECT doc_id, round(boosted, 6) AS similarity, round(similarity, 6) AS original_score FROM e",
    "pipeline_debug_counts": PIPE + """, n AS (SELECT (SELECT count(*) FROM near) AS n0, (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2,
        (SELECT count(*) FROM c) AS n3, (SELECT count(*) FROM e) AS n5)
      SELECT 'score' AS stage, 0 AS position, n0 AS before_count, n1 AS after_count FROM n UNION ALL SELECT 'status', 1, n1, n2 FROM n
      UNION ALL SELECT 'query_filter', 2, n2, n3 FROM n UNION ALL SELECT 'time_boost', 3, n3, n3 FROM n UNION ALL SELECT 'limit', 4, n3, n5 FROM n""",
    "score_envelope": hybrid(10) + " SELECT doc_id, round(similarity, 6) AS score_semantic, round(bm25, 6) AS score_bm25, round(rrf, 6) AS score_rrf, round(rrf, 6) AS score_final FROM found",
    "filter_min_score": f"WITH {NOTE}, {SIM} SELECT doc_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.1",
    "filter_status": f"WITH {NOTE} SELECT doc_id, status FROM note WHERE status IS NULL OR status NOT IN ('inactive', 'hidden')",
    "filter_type": _only("lang = 'fr'"),
    "filter_props": _only("(lang = 'en' OR source = 'src2') AND source <> 'src3'"),
    "filter_tags": _only("(list_contains(tags, 'daily') OR source = 'src5') AND lang <> 'fr'"),
    "filter_paths": _only("contains(relative_path, 'src1') AND NOT contains(relative_path, '/fr/')"),
    "filter_files": _only("(contains(doc_id || '.md', '12') OR contains(doc_id || '.md', '99')) AND NOT contains(doc_id || '.md', '5')"),
    "filter_combined": _only("lang = 'en' AND doc_id % 7 <> 0 AND contains(relative_path, 'src1') AND NOT contains(doc_id || '.md', '0.md')"),
    "tokenize": r"""SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term""",
    "clean_markdown": f"WITH {MD}, c AS (SELECT doc_id, {cleaned('t')} AS c FROM md) SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_chars FROM c",
    "read_notes": f"""WITH c AS (SELECT *, 'from ' || source || '. ' || {cleaned("'# Head' || chr(10) || text")} AS c FROM documents)
      SELECT source || '/' || doc_id || '.md' AS relative_path, 'Note ' || doc_id AS title, lang || ',' || source AS tags,
      md5(c) AS content_md5, length(c) AS content_chars, 'description,tags,title' AS head_names FROM c""",
    "snippet": f"""WITH t AS (SELECT doc_id, text AS c, length(text) AS n,
        least(nullif(strpos(lower(text), 'thing'), 0), nullif(strpos(lower(text), 'ononeda'), 0)) - 1 AS pos FROM documents),
      w AS (SELECT *, greatest(0, pos - 75) AS wanted FROM t),
      b AS (SELECT *, CASE WHEN wanted + 150 >= n THEN greatest(0, n - 150) ELSE wanted END AS a FROM w),
      r AS (SELECT *, least(n, a + 150) AS e, substr(c, a + 1, least(n, a + 150) - a) AS raw FROM b),
      o AS (SELECT *, CASE WHEN a = 0 THEN raw WHEN strpos(raw, ' ') BETWEEN 2 AND 30 THEN '...' || substr(raw, strpos(raw, ' ')) ELSE '...' || raw END AS opened FROM r),
      x AS (SELECT *, CASE WHEN contains(opened, ' ') THEN length(opened) - strpos(reverse(opened), ' ') ELSE -1 END AS cut FROM o)
      SELECT doc_id, CASE WHEN pos IS NULL THEN trim(substr(c, 1, 150), {BLANKS}) || CASE WHEN n > 150 THEN '...' ELSE '' END
        ELSE trim(CASE WHEN e >= n THEN opened WHEN cut > length(opened) - 30 THEN substr(opened, 1, cut) || '...' ELSE opened || '...' END, {BLANKS}) END AS snippet FROM x""",
    "query_expansion_terms": rf"""WITH {NOTE}, {SIM}, {near(5)},
      w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOPS}, x)) AS w FROM near),
      e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL),
      top AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100),
      u AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM near)) / (1 + df)) + 1) AS u FROM tf JOIN top USING (term)),
      v AS (SELECT term, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id)) AS v FROM u),
      mean AS (SELECT term, sum(v) / (SELECT count(*) FROM near) AS weight FROM v GROUP BY 1),
      best AS (SELECT * FROM mean ORDER BY round(weight, 9) DESC, term LIMIT 3)
      SELECT term, round(weight, 6) AS weight FROM best WHERE NOT contains('the', term)""",
    "rate_limit_remaining": """WITH RECURSIVE r AS (SELECT user_id, event_type, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
      go AS (SELECT user_id, event_type, k, [us] AS held FROM r WHERE k = 1 UNION ALL
        SELECT r.user_id, r.event_type, r.k, CASE WHEN len(list_filter(held, lambda x: r.us - x < 864000000000)) < 3
          THEN list_append(list_filter(held, lambda x: r.us - x < 864000000000), r.us) ELSE list_filter(held, lambda x: r.us - x < 864000000000) END
        FROM go JOIN r ON r.user_id = go.user_id AND r.event_type = go.event_type AND r.k = go.k + 1),
      all_admitted AS (SELECT DISTINCT user_id, event_type, unnest(held) AS us FROM go)
      SELECT user_id AS client, event_type AS endpoint,
        greatest(0, 3 - count(*) FILTER (epoch_us(TIMESTAMP '2024-01-20') - us BETWEEN 0 AND 863999999999)) AS remaining FROM all_admitted GROUP BY ALL""",
    "inline_tags": f"""WITH {MD} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '#([A-Za-z0-9_-]+)', 1))), ',') AS tags FROM md""",
    "frontmatter_split": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'title: t' || doc_id END AS head, md5(text) AS body_md5 FROM documents",
    "content_description": f"WITH t AS (SELECT doc_id, trim(text, {BLANKS}) AS c, substr(trim(text, {BLANKS}), 1, 150) AS h FROM documents) SELECT doc_id, {DESCRIBED} AS description FROM t",
    "result_links": """WITH p AS (SELECT doc_id, source || '/a%20b~%2A%C3%A9%2B' || lang || '/' || doc_id AS u FROM documents)
      SELECT doc_id, 'obsidian://vault/main/' || u AS uri, '[[' || doc_id || ']]' AS wiki FROM p""",
    "path_parts": f"WITH {NOTE} SELECT doc_id, doc_id || '.md' AS base, source || '/' || lang AS parent, CAST(doc_id AS VARCHAR) AS stem FROM note",
    "extract_date": f"""WITH {NOTE} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN CAST(modified AS DATE)
      ELSE CAST(DATE '2022-01-01' + CAST(doc_id * 37 % 730 AS INTEGER) AS DATE) END AS date FROM note""",
    "parse_json_filters": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 4 = 0 THEN lang || ',' || source ELSE '' END AS joined FROM documents""",
    "sanitize_scores": "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN round(value, 6) END AS value FROM events",
    "scan_discover": f"WITH {PATHS} SELECT relative_path FROM notes WHERE NOT contains(relative_path, '0000013')",
    "strategic_subset": f"""WITH {PATHS}, s AS (
        SELECT relative_path, 'daily' AS subset, row_number() OVER (ORDER BY relative_path DESC) AS r, 50 AS k FROM notes WHERE relative_path LIKE 'Daily/%'
        UNION ALL SELECT relative_path, 'tech', row_number() OVER (ORDER BY relative_path), 40 FROM notes WHERE relative_path LIKE 'Reference/Tech/%'
        UNION ALL SELECT relative_path, 'culture', row_number() OVER (ORDER BY relative_path), 30 FROM notes WHERE relative_path LIKE 'Reference/Culture/%'
        UNION ALL SELECT relative_path, 'letters', row_number() OVER (ORDER BY relative_path), 50 FROM notes WHERE relative_path LIKE 'L/%'
        UNION ALL SELECT relative_path, 'reference', row_number() OVER (ORDER BY relative_path), 30 FROM notes WHERE relative_path LIKE 'Reference/Other/%')
      SELECT relative_path, subset FROM s WHERE r <= k""",
    "chunk_documents": f"WITH {BASE}, {CHUNKS} SELECT doc_id, chunk_index, chunk_total, chunk_start, chunk_end, md5(content) AS text_md5 FROM chunks",
    "chunk_statistics": f"""WITH {BASE}, {CHUNKS} SELECT count(*) AS num_chunks, round(avg(length(content)), 6) AS avg_chunk_size, min(length(content)) AS min_chunk_size,
      max(length(content)) AS max_chunk_size, max(chunk_end) AS total_content_size, round(avg(length(content) // 4), 6) AS avg_estimated_tokens FROM chunks""",
    "index_changes": CHANGES + " SELECT relative_path, change_type FROM changes",
    "index_merge": CHANGES + f""", base AS (SELECT relative_path, content, 'old' AS origin FROM old WHERE relative_path NOT IN (SELECT relative_path FROM changes)
        UNION ALL SELECT relative_path, content, 'fresh' FROM now WHERE relative_path IN (SELECT relative_path FROM changes WHERE change_type <> 'deleted')),
      {CHUNKS} SELECT relative_path, chunk_index, origin FROM chunks""",
    "index_clean_stale": CHANGES + " SELECT relative_path FROM old WHERE relative_path IN (SELECT relative_path FROM now)",
    "index_stats": f"""WITH {NOTE} SELECT count(*) AS num_items, round(avg(length(content)), 6) AS avg_content_length, count(DISTINCT source || '/' || lang) AS directories,
      (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM note)) AS unique_tags FROM note""",
    "index_summary": f"""WITH {NOTE}, base AS (SELECT relative_path, content FROM note), {CHUNKS}
      SELECT count(*) AS items, count(*) FILTER (chunk_total > 1) AS chunks, count(DISTINCT relative_path) AS files FROM chunks""",
    "vault_info": f"WITH {NOTE} SELECT 'main' AS vault, count(*) AS files, strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS last_modified FROM note",
    "model_compat": """WITH m(name, dimensions) AS (VALUES ('all-MiniLM-L6-v2', 384), ('all-MiniLM-L12-v2', 384), ('all-mpnet-base-v2', 768),
        ('multi-qa-mpnet-base-cos-v1', 768), ('paraphrase-albert-small-v2', 768))
      SELECT a.name, b.name AS other, a.dimensions FROM m a JOIN m b ON a.dimensions = b.dimensions AND a.name <> b.name""",
    "archaeology_entries": DATED + " SELECT CAST(date AS DATE) AS date, relative_path, round(similarity, 6) AS similarity, doc_id || '.md: ' || substr(content, 1, 200) AS snippet FROM entries",
    "archaeology_monthly": DATED + " SELECT month, round(intensity, 6) AS intensity, activity FROM months",
    "archaeology_peaks": DATED + " SELECT month, round(intensity, 6) AS intensity FROM months WHERE intensity >= 0.2",
    "archaeology_dormant": DATED + """, ends AS (SELECT CAST(min(month) || '-01' AS DATE) AS a, CAST(max(month) || '-01' AS DATE) AS b FROM months),
      span AS (SELECT strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM ends)
      SELECT month FROM span WHERE month NOT IN (SELECT month FROM months)""",
    "archaeology_bars": DATED + """, f AS (SELECT month, CAST(floor(activity / (max(activity) OVER ()) * 50) AS INTEGER) AS f, sum(activity) OVER () AS s, count(*) OVER () AS n FROM months)
      SELECT month, repeat('=', f) || repeat('-', 50 - f) AS bar FROM f WHERE s >= 10 AND n >= 3""",
    "archaeology_top": DATED + " SELECT doc_id, CAST(date AS DATE) AS date, round(similarity, 6) AS similarity FROM entries ORDER BY round(similarity, 9) DESC, doc_id LIMIT 20",
    "log_stats_totals": f"""WITH {LOG} SELECT count(*) AS searches, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
      FROM log WHERE error IS NULL""",
    "log_by_mode": f"WITH {LOG} SELECT coalesce(mode, 'unknown') AS mode, count(*) AS searches FROM log WHERE error IS NULL GROUP BY 1",
    "log_timing": f"""WITH {LOG} SELECT CAST(round_even(coalesce(avg(retrieval_ms), 0), 0) AS BIGINT) AS avg_retrieval_ms, CAST(round_even(coalesce(avg(total_ms), 0), 0) AS BIGINT) AS avg_total_ms
      FROM log WHERE error IS NULL AND total_ms IS NOT NULL""",
    "log_recent": f"WITH {LOG} SELECT id, mode, error FROM log ORDER BY id DESC LIMIT 25",
    "log_score_summary": """WITH s AS (SELECT event_id % 97 AS search_id, value * (event_id % 3 + 1) AS x FROM events)
      SELECT search_id, round(max(x), 6) AS top_score, round(CASE WHEN count(x) >= 2 THEN median(x) END, 6) AS score_p50, count(*) AS results FROM s GROUP BY 1""",
    "log_append": """SELECT user_id, round(max(round(value, 4)), 6) AS top_score, round(CASE WHEN count(*) >= 2 THEN median(round(value, 4)) END, 6) AS score_p50,
      count(*) AS result_count FROM events GROUP BY 1""",
    "log_stream": """SELECT user_id, count(*) AS searches, round(max(round(value, 4)) + 1, 6) AS top_score, round(max(round(value, 4)) + 0.5, 6) AS score_p50,
      count(*) * 2 AS results FROM events GROUP BY 1""",
    "rate_limit_window": """SELECT event_id AS request_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)
      RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS earlier FROM events""",
    # With one request admitted per day, the next admitted one is the first at least a day after the last admitted one.
    "rate_limit_exact": """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
      go AS (SELECT user_id, event_type, k, event_id, us AS last_us, true AS allowed FROM r WHERE k = 1 UNION ALL
        SELECT r.user_id, r.event_type, r.k, r.event_id, CASE WHEN r.us - go.last_us >= 86400000000 THEN r.us ELSE go.last_us END,
          r.us - go.last_us >= 86400000000 FROM go JOIN r ON r.user_id = go.user_id AND r.event_type = go.event_type AND r.k = go.k + 1)
      SELECT event_id AS request_id, allowed FROM go""",
}

# The same answers by way of tables on disk.
ORACLE_SQL |= {
    "saved_bm25_search": ORACLE_SQL["bm25_search"],
    "saved_bm25_prefilter": ORACLE_SQL["bm25_prefilter"],
    "saved_bm25_scores": ORACLE_SQL["bm25_scores"],
    "saved_hybrid_search": ORACLE_SQL["hybrid_search"],
    "index_roundtrip": ORACLE_SQL["semantic_topk"],
    "index_snapshot_merge": ORACLE_SQL["index_merge"],
    "bm25_described_text": f"""WITH {NOTE}, d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS d FROM note)
      SELECT doc_id, md5(concat_ws(' ', title, array_to_string(list_concat(tags, tags), ' '), d, d, content)) AS text_md5 FROM d""",
}
