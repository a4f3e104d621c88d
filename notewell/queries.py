"""Named queries over the supplied tables, one for each operator of the library."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.vectors import cosine
from .operators import block_postings, chunking, expansion, filters, fusion, lexical, log_stats, maintenance, pair_scoring, ranking, rate_limit, topics, vector_codes
from .operators.filters import QueryFilter, Wanted
from .plans import search
from .plans.registry import MODELS
from .sources import notes as nt
from .sources.files import scratch_folder
from .sources.index_store import vault_metadata
from .sources.query_log import log_rows
from .sources.snapshots import SnapshotStore
from .streaming import log_sink


QUERY = "the thing src7 ily"
SHORT_QUERY = "the"
NOW = "2024-02-01 00:00:00"
VEC_ID = 0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vector(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").filter(F.col("vec_id") == VEC_ID).select(F.col("embedding").alias("q"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = nt.note_table(spark, sf).filter("embedding IS NOT NULL")
    return search.similarity(rows, _vector(spark, sf)).filter("similarity IS NOT NULL")


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """The notes with their vectors, as a search over both reads them."""
    return nt.note_table(spark, sf, ("embeddings",))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a keyword index reads of the notes."""
    return nt.note_table(spark, sf, ()).select("doc_id", "title", "tags", "content")


def _index(notes: DataFrame) -> lexical.LexicalIndex:
    return lexical.build_index(notes, lexical.index_text())


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _joined(name: str):
    return F.array_join(F.col(name), ",").alias(name)


# Retrieval ---------------------------------------------------------------------------------------------------------


@_query
def cosine_pairs(spark, sf):
    v = _read(spark, sf, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(cosine("va", "vb"), 6).alias("cosine"))


@_query
def semantic_topk(spark, sf):
    out = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 20)
    return out.select("doc_id", _r("similarity"))


@_query
def semantic_search(spark, sf):
    out = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 10)
    return out.select(
        "doc_id", "relative_path", "title", _r("similarity"), tx.description("content").alias("description"), tx.wiki_link("title").alias("wiki_link")
    )


@_query
def prefilter_semi(spark, sf):
    rows = nt.note_table(spark, sf)
    allowed = filters.allowed_files(rows, paths=("src7/", "src1/"))
    return search.semantic_topk(rows, _vector(spark, sf), 10, allowed).select("doc_id", _r("similarity"))


@_query
def bm25_index_text(spark, sf):
    rows = nt.note_table(spark, sf)
    return rows.select("doc_id", F.md5(lexical.index_text().cast("binary")).alias("text_md5"))


@_query
def bm25_corpus_stats(spark, sf):
    index = _index(_texts(spark, sf))
    df = index.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return index.corpus.crossJoin(df).select("n_docs", _r("avgdl"), _r("avg_idf"), "terms", "postings")


@_query
def bm25_scores(spark, sf):
    return lexical.scores(_index(_texts(spark, sf)), QUERY).select("doc_id", _r("bm25"))


@_query
def bm25_search(spark, sf):
    rows = nt.note_table(spark, sf, ())
    out = lexical.search(_index(_texts(spark, sf)), rows.select("doc_id", "relative_path", "tags"), QUERY)
    return out.select("doc_id", "relative_path", _r("bm25"), _r("bm25_base"))


_saved: dict[tuple[str, str], tuple[str, set[str]]] = {}
_PARTS = ("lexical", "vectors")


def saved_index(spark: SparkSession, sf: str, parts: Sequence[str] = _PARTS) -> str:
    """The folder of these tables' saved keyword index (lexical) and vector codes (vectors); each part is written once in
    a session, when it is first asked for."""
    path, written = _saved.setdefault((spark.sparkContext.applicationId, sf), (scratch_folder(spark, "saved"), set()))
    if "lexical" in parts and "lexical" not in written:
        block_postings.save(_texts(spark, sf), lexical.index_text(), f"{path}/lexical")
        written.add("lexical")
    if "vectors" in parts and "vectors" not in written:
        vector_codes.save(nt.note_table(spark, sf, ("embeddings",)), f"{path}/vectors")
        written.add("vectors")
    return path


@_query
def saved_bm25_search(spark, sf):
    index = block_postings.SavedIndex.load(spark, f"{saved_index(spark, sf, ('lexical',))}/lexical")
    out = index.search(nt.note_table(spark, sf, ()).select("doc_id", "relative_path", "tags"), QUERY)
    return out.select("doc_id", "relative_path", _r("bm25"), _r("bm25_base"))


@_query
def saved_bm25_prefilter(spark, sf):
    index = block_postings.SavedIndex.load(spark, f"{saved_index(spark, sf, ('lexical',))}/lexical")
    rows = nt.note_table(spark, sf, ())
    allowed = filters.allowed_files(rows, paths=("src3/",))
    return index.search(rows.select("doc_id", "tags"), QUERY, allowed=allowed).select("doc_id", _r("bm25"))


@_query
def saved_bm25_scores(spark, sf):
    index = block_postings.SavedIndex.load(spark, f"{saved_index(spark, sf, ('lexical',))}/lexical")
    return index.scores(index.weights(QUERY)).select("doc_id", _r("bm25"))


@_query
def index_roundtrip(spark, sf):
    out = vector_codes.search(spark, f"{saved_index(spark, sf, ('vectors',))}/vectors", _vector(spark, sf), 20)
    return out.select("doc_id", _r("similarity"))


@_query
def saved_hybrid_search(spark, sf):
    rows, path, vector = _notes(spark, sf), saved_index(spark, sf), _vector(spark, sf)
    index = block_postings.SavedIndex.load(spark, f"{path}/lexical")
    out = search.hybrid(rows, index, QUERY, vector, nearest=lambda n: vector_codes.search(spark, f"{path}/vectors", vector, n))
    return out.select("doc_id", "relative_path", _r("rrf", 9), _r("similarity"), _r("bm25"), "tag_boosted")


@_query
def bm25_described_text(spark, sf):
    rows = nt.note_table(spark, sf).withColumn("description", F.expr("if(doc_id % 3 = 0, null, tags[1])"))
    return rows.select("doc_id", F.md5(lexical.index_text(description=F.col("description")).cast("binary")).alias("text_md5"))


@_query
def bm25_tag_boost(spark, sf):
    rows = nt.note_table(spark, sf).select("doc_id", "tags")
    out = lexical.with_tag_boost(rows.withColumn("bm25", F.lit(1.5)), QUERY)
    return out.select("doc_id", _joined("tags_matched"), "bm25")


@_query
def bm25_prefilter(spark, sf):
    rows = nt.note_table(spark, sf, ())
    allowed = filters.allowed_files(rows, paths=("src3/",))
    return lexical.search(_index(_texts(spark, sf)), rows.select("doc_id", "tags"), QUERY, allowed=allowed).select("doc_id", _r("bm25"))


@_query
def rrf_fusion(spark, sf):
    rows = _notes(spark, sf)
    near = search.semantic_topk(rows, _vector(spark, sf), 30)
    words = lexical.search(_index(_texts(spark, sf)), rows.select("doc_id", "tags"), QUERY, limit=30)
    return fusion.top(fusion.rrf([(near, "similarity"), (words, "bm25")]), "rrf", 20).select("doc_id", _r("rrf", 9))


def _hybrid(spark, sf, limit=10, boosts=True):
    rows = _notes(spark, sf)
    return search.hybrid(rows, _index(_texts(spark, sf)), QUERY, _vector(spark, sf), limit, boosts)


@_query
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("doc_id", "relative_path", _r("rrf", 9), _r("similarity"), _r("bm25"), "tag_boosted")


@_query
def hybrid_tag_boost(spark, sf):
    return _hybrid(spark, sf, 30).filter("tag_boosted").select("doc_id", _r("rrf", 9), _joined("tags_matched"))


@_query
def hybrid_keyword_boost(spark, sf):
    rows, texts = (df.withColumn("tags", F.array().cast("array<string>")) for df in (_notes(spark, sf), _texts(spark, sf)))
    out = search.hybrid(rows, _index(texts), QUERY, _vector(spark, sf), 30)
    return out.filter("similarity_rank IS NULL").select("doc_id", _r("rrf", 9), _r("bm25"))


def _chunks_scored(spark, sf):
    rows = chunking.chunk(nt.note_table(spark, sf).select("doc_id", "relative_path", "content"))
    hits = F.size(F.regexp_extract_all(F.lower("content"), F.lit("the "), F.lit(0)))
    return rows.withColumn("score", hits / F.length("content"))


@_query
def dedup_best(spark, sf):
    out = fusion.best_per_file(_chunks_scored(spark, sf), "score")
    return out.select("relative_path", "best_chunk_index", "matched_chunks", "chunk_total", _r("score"))


@_query
def dedup_all(spark, sf):
    out = fusion.some_per_file(_chunks_scored(spark, sf), "score", 2)
    return out.select("relative_path", "chunk_index", "file_rank", _r("score"))


# Expansion, second stage, recency ----------------------------------------------------------------------------------


@_query
def expand_gate(spark, sf):
    rows = _read(spark, sf, "benchmark")
    return rows.select("item_id", (F.size(tx.tokenize("text")) < expansion.MAX_WORDS).alias("expands"))


@_query
def query_expansion_terms(spark, sf):
    seeds = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), expansion.SEEDS)
    return expansion.expansion_terms(seeds, SHORT_QUERY).select("term", _r("weight"))


@_query
def rerank_topk(spark, sf):
    near = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 40)
    return ranking.rerank(near, "similarity", ranking.lexical_overlap(QUERY), 10, 30).select("doc_id", _r("cross_encoder"))


def _pair_model(spark, sf):
    asking = _read(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return pair_scoring.fit(pair_scoring.cloze_pairs(_read(spark, sf, "documents"), asking))


@_query
def pair_model_weights(spark, sf):
    """The second stage's model, fitted on the texts of all documents that are labelled good."""
    rows = [(name, b, x) for name, own in zip(pair_scoring.FEATURES, _pair_model(spark, sf).weights) for b, x in enumerate(own)]
    return spark.createDataFrame(rows, "feature string, bin int, weight double").select("feature", "bin", _r("weight"))


@_query
def pair_rerank(spark, sf):
    near = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 40)
    score = pair_scoring.scorer(_pair_model(spark, sf))(QUERY)
    return ranking.rerank(near, "similarity", score, 10, 30).select("doc_id", _r("cross_encoder"))


@_query
def time_boost(spark, sf):
    near = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 40)
    return ranking.time_boost(near, NOW, "similarity").select("doc_id", _r("similarity"), _r("time_boost"), _r("original_score"))


# Pipelines ---------------------------------------------------------------------------------------------------------

_FILTER = QueryFilter(types=Wanted(("en", "de")), tags=Wanted((), ("#Daily",)), paths=Wanted((), ("src13/",)))


@_query
def pipeline_default(spark, sf):
    near = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 60)
    params = search.SearchParams(QUERY, mode="semantic", limit=10, min_score=0.05, now=NOW, query_filter=_FILTER)
    return search.run_stages(near, params).select("doc_id", _r("similarity"), _r("original_score"))


@_query
def pipeline_debug_counts(spark, sf):
    near = search.semantic_topk(nt.note_table(spark, sf), _vector(spark, sf), 60)
    params = search.SearchParams(QUERY, mode="semantic", limit=10, min_score=0.05, now=NOW, query_filter=_FILTER)
    return search.stage_counts(near, params)


@_query
def score_envelope(spark, sf):
    rows = ranking.envelope(_hybrid(spark, sf), "rrf")
    return rows.select("doc_id", *[F.round(F.col(f"scores.{n}"), 6).alias(f"score_{n}") for n in ("semantic", "bm25", "rrf", "final")])


# Filters -----------------------------------------------------------------------------------------------------------


@_query
def filter_min_score(spark, sf):
    return filters.min_score(_scored(spark, sf), 0.1).select("doc_id", _r("similarity"))


@_query
def filter_status(spark, sf):
    return filters.visible(nt.note_table(spark, sf)).select("doc_id", "status")


@_query
def filter_type(spark, sf):
    return nt.note_table(spark, sf).filter(filters.type_is(Wanted(("fr", "es"), ("es",)))).select("doc_id")


@_query
def filter_props(spark, sf):
    wanted = Wanted((("lang", "EN"), ("source", "src2"), ("", "x")), (("source", "SRC3"),))
    return nt.note_table(spark, sf).filter(filters.property_is(wanted)).select("doc_id")


@_query
def filter_tags(spark, sf):
    return nt.note_table(spark, sf).filter(filters.tag_is(Wanted(("#DAILY", "src5"), ("##fr",)))).select("doc_id")


@_query
def filter_paths(spark, sf):
    return nt.note_table(spark, sf).filter(filters.path_has(Wanted(("src1",), ("/fr/",)))).select("doc_id")


@_query
def filter_files(spark, sf):
    return nt.note_table(spark, sf).filter(filters.file_has(Wanted(("12", "99"), ("5",)))).select("doc_id")


@_query
def filter_combined(spark, sf):
    wanted = QueryFilter(Wanted(("en",)), Wanted((("lang", "en"),)), Wanted((), ("daily",)), Wanted(("src1",)), Wanted((), ("0.md",)))
    return filters.apply_filter(nt.note_table(spark, sf), wanted).select("doc_id")


# Text --------------------------------------------------------------------------------------------------------------


@_query
def tokenize(spark, sf):
    words = _read(spark, sf, "documents").select(F.explode(tx.tokenize("text")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


_MARKED = "replace(replace(replace(replace(text, ' the ', ' **the** '), ' and ', ' [[and]] '), ' of ', concat(' [of](http://x/', doc_id, ') ')), ' in ', concat(' `in` #in-', doc_id % 5, ' '))"
_DRESSED = f"concat('# ', {_MARKED}, '\n\n[[note ', doc_id, ']] *x* `c`\n#tag', doc_id % 5, ' #b-', doc_id % 3)"


def _whole(name: str):
    """A text of any length as its digest and its number of characters."""
    return F.md5(F.col(name).cast("binary")).alias(f"{name}_md5"), F.length(name).cast("long").alias(f"{name}_chars")


@_query
def clean_markdown(spark, sf):
    rows = _read(spark, sf, "documents").select("doc_id", F.expr(_DRESSED.replace("\n", "\\n")).alias("md"))
    return rows.select("doc_id", tx.clean_markdown("md").alias("clean")).select("doc_id", *_whole("clean"))


@_query
def inline_tags(spark, sf):
    rows = _read(spark, sf, "documents").select("doc_id", F.expr(_DRESSED.replace("\n", "\\n")).alias("md"))
    return rows.select("doc_id", F.array_join(tx.inline_tags("md"), ",").alias("tags"))


@_query
def frontmatter_split(spark, sf):
    rows = _read(spark, sf, "documents").select(
        "doc_id", F.expr("if(doc_id % 2 = 0, concat('---\\ntitle: t', doc_id, '\\n---\\n', text), text)").alias("raw")
    )
    parts = rows.select("doc_id", nt.split_frontmatter("raw").alias("s"))
    return parts.select("doc_id", F.col("s.head").alias("head"), F.md5(F.col("s.body").cast("binary")).alias("body_md5"))


@_query
def read_notes(spark, sf):
    raw = F.expr("concat('---\\ntitle: Note ', doc_id, '\\ntags: [', lang, ', ', source, ']\\ndescription: from ', source, '\\n---\\n# Head\\n', text)")
    files = _read(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"),
        raw.alias("raw"),
        F.lit(None).cast("timestamp").alias("modified"),
    )
    return nt.read_notes(files).select("relative_path", "title", _joined("tags"), *_whole("content"), F.map_keys("frontmatter").alias("_k")).withColumn("head_names", F.array_join(F.array_sort("_k"), ",")).drop("_k")


@_query
def snippet(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.snippet("text", "thing ononeda of").alias("snippet"))


@_query
def content_description(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.description("text").alias("description"))


@_query
def result_links(spark, sf):
    path = F.expr("concat(source, '/a b~*é+', lang, '/', doc_id, '.md')")
    rows = _read(spark, sf, "documents").select("doc_id", path.alias("p"))
    return rows.select("doc_id", tx.deep_link("main", "p").alias("uri"), tx.wiki_link(tx.stem("p")).alias("wiki"))


@_query
def path_parts(spark, sf):
    rows = nt.note_table(spark, sf).select("doc_id", "relative_path")
    return rows.select("doc_id", tx.base_name("relative_path").alias("base"), tx.parent("relative_path").alias("parent"), tx.stem("relative_path").alias("stem"))


@_query
def extract_date(spark, sf):
    day = "date_format(date_add(date'2022-01-01', cast(doc_id * 37 % 730 as int)), 'yyyy-MM-dd')"
    path = F.expr(f"concat(source, '/', case when doc_id % 3 = 0 then {day} when doc_id % 3 = 1 then '2024-13-45' else 'x' end, '.md')")
    created = F.expr(f"case when doc_id % 3 = 1 then {day} end")
    rows = nt.note_table(spark, sf).join(_read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", tx.note_date(path, created, F.col("modified")).alias("date"))


@_query
def parse_json_filters(spark, sf):
    raw = F.expr("case doc_id % 4 when 0 then concat('[\"', lang, '\",\"', source, '\"]') when 1 then 'no json' when 2 then '{\"a\":1}' end")
    rows = _read(spark, sf, "documents").select("doc_id", tx.json_list(raw).alias("v"))
    return rows.select("doc_id", F.size("v").alias("n"), F.array_join("v", ",").alias("joined"))


@_query
def sanitize_scores(spark, sf):
    odd = F.expr("case event_id % 5 when 0 then double('NaN') when 1 then double('Infinity') else value end")
    return _read(spark, sf, "events").select("event_id", F.round(tx.finite(odd), 6).alias("value"))


# Sources and maintenance -------------------------------------------------------------------------------------------


def _paths(spark, sf):
    form = F.expr(
        """concat(case doc_id % 8 when 0 then 'Daily' when 1 then 'Reference/Tech' when 2 then 'Reference/Culture' when 3 then 'L'
           when 4 then 'Reference/Other' when 5 then '.trash' when 6 then 'Utilities' else 'node_modules/x' end,
           '/', lpad(cast(doc_id as string), 7, '0'), if(doc_id % 11 = 0, '.pdf', '.md'))"""
    )
    return _read(spark, sf, "documents").select(form.alias("relative_path"))


@_query
def scan_discover(spark, sf):
    return nt.discover(_paths(spark, sf), patterns=("0000013",))


@_query
def strategic_subset(spark, sf):
    return nt.strategic_subset(nt.discover(_paths(spark, sf)))


@_query
def chunk_documents(spark, sf):
    rows = chunking.chunk(_read(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", "chunk_index", "chunk_total", "chunk_start", "chunk_end", F.md5(F.col("content").cast("binary")).alias("text_md5"))


@_query
def chunk_statistics(spark, sf):
    rows = chunking.chunk(_read(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    out = chunking.statistics(rows)
    return out.select("num_chunks", _r("avg_chunk_size"), "min_chunk_size", "max_chunk_size", "total_content_size", _r("avg_estimated_tokens"))


def _change_tables(spark, sf):
    rows = nt.note_table(spark, sf, ("events",)).select("doc_id", "relative_path", "modified", "content", "tags")
    later = F.expr("if(doc_id % 10 = 3, modified + interval 1 second, modified)")
    current = rows.filter("doc_id % 10 != 1").withColumn("modified", later)
    return current, rows.filter("doc_id % 10 != 2")


@_query
def index_changes(spark, sf):
    return maintenance.changes(*_change_tables(spark, sf))


@_query
def index_merge(spark, sf):
    current, tracked = _change_tables(spark, sf)
    old = chunking.chunk(tracked).withColumn("origin", F.lit("old"))
    fresh = chunking.chunk(current).withColumn("origin", F.lit("fresh"))
    out = maintenance.merge(old, maintenance.changes(current, tracked), fresh)
    return out.select("relative_path", "chunk_index", "origin")


@_query
def index_snapshot_merge(spark, sf):
    current, tracked = _change_tables(spark, sf)
    store = SnapshotStore(spark, scratch_folder(spark, "snapshots"), "main")
    store.replace(chunking.chunk(tracked).withColumn("origin", F.lit("old")))
    store.merge(maintenance.changes(current, tracked), chunking.chunk(current).withColumn("origin", F.lit("fresh")))
    return store.rows().select("relative_path", "chunk_index", "origin")


@_query
def index_clean_stale(spark, sf):
    current, tracked = _change_tables(spark, sf)
    return maintenance.without_stale(tracked, current).select("relative_path")


@_query
def index_stats(spark, sf):
    out = maintenance.index_stats(nt.note_table(spark, sf))
    return out.select("num_items", _r("avg_content_length"), "directories", "unique_tags")


@_query
def index_summary(spark, sf):
    return maintenance.summary(chunking.chunk(nt.note_table(spark, sf).select("doc_id", "relative_path", "content")))


@_query
def vault_info(spark, sf):
    return vault_metadata(nt.note_table(spark, sf), "main").select("vault", "files", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


@_query
def model_compat(spark, sf):
    rows = spark.createDataFrame([(m.name, m.dimensions) for m in MODELS], "name string, dimensions int")
    other = rows.select(F.col("name").alias("other"), F.col("dimensions").alias("d"))
    return rows.join(other, (F.col("d") == F.col("dimensions")) & (F.col("name") != F.col("other"))).select("name", "other", "dimensions")


# Topics ------------------------------------------------------------------------------------------------------------


def _dated(spark, sf):
    return _scored(spark, sf).withColumn("date", F.expr("date_add(date'2022-01-01', cast(doc_id * 37 % 730 as int))"))


def _entries(spark, sf):
    return topics.entries(_dated(spark, sf), threshold=0.05, exclude_daily=True)


@_query
def archaeology_entries(spark, sf):
    return _entries(spark, sf).select("date", "relative_path", _r("similarity"), F.concat(tx.base_name("relative_path"), F.lit(": "), F.substring("content", 1, 200)).alias("snippet"))


@_query
def archaeology_monthly(spark, sf):
    return topics.monthly(_entries(spark, sf)).select("month", _r("intensity"), "activity")


@_query
def archaeology_peaks(spark, sf):
    return topics.peaks(topics.monthly(_entries(spark, sf)), 0.2).select("month", _r("intensity"))


@_query
def archaeology_dormant(spark, sf):
    return topics.dormant(topics.monthly(_entries(spark, sf)))


@_query
def archaeology_bars(spark, sf):
    return topics.bars(topics.monthly(_entries(spark, sf)))


@_query
def archaeology_top(spark, sf):
    return topics.strongest(_entries(spark, sf)).select("doc_id", "date", _r("similarity"))


# Log and limits ----------------------------------------------------------------------------------------------------


def _log(spark, sf):
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("nullif(event_type, 'view')").alias("mode"),
        F.col("value").alias("total_ms"),
        (F.col("value") / 2).alias("retrieval_ms"),
        F.expr("if(event_type = 'error', 'failed', null)").alias("error"),
    )


_STAMP = "yyyy-MM-dd HH:mm:ss"


@_query
def log_stats_totals(spark, sf):
    out = log_stats.totals(_log(spark, sf))
    return out.select("searches", F.date_format("first_ts", _STAMP).alias("first_ts"), F.date_format("last_ts", _STAMP).alias("last_ts"))


@_query
def log_by_mode(spark, sf):
    return log_stats.by_mode(_log(spark, sf))


@_query
def log_timing(spark, sf):
    return log_stats.timing(_log(spark, sf))


@_query
def log_recent(spark, sf):
    return log_stats.recent(_log(spark, sf), 25).select("id", "mode", "error")


@_query
def log_score_summary(spark, sf):
    rows = _read(spark, sf, "events").select(
        (F.col("event_id") % 97).alias("search_id"),
        F.expr("if(event_id % 3 = 0, value, null)").alias("cross_encoder"),
        F.expr("if(event_id % 3 = 1, value * 2, null)").alias("rrf"),
        F.expr("if(event_id % 3 = 2, value * 3, null)").alias("similarity"),
        F.lit(None).cast("double").alias("bm25"),
    )
    return log_stats.score_summary(rows).select("search_id", _r("top_score"), _r("score_p50"), "results")


@_query
def log_append(spark, sf):
    rows = _read(spark, sf, "events").groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("event_id").cast("string").alias("path"), F.round("value", 4).alias("score")))).alias("results")
    )
    return log_rows(rows).select("user_id", _r("top_score"), _r("score_p50"), F.col("result_count").cast("long").alias("result_count"))


@_query
def log_stream(spark, sf):
    """All events as a stream of searches into the log; then its first batch comes once more, which adds nothing."""
    schema = _read(spark, sf, "events").schema
    hit = lambda name, more: F.struct(F.lit(name).alias("path"), (F.round("value", 4) + more).alias("score"))
    searches = lambda events: events.select("event_id", "user_id", F.array(hit("a", 0), hit("b", 1)).alias("results"))
    path = scratch_folder(spark, "log")
    stream = searches(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
    log_sink.log_stream(stream, path, "events", scratch_folder(spark, "log-stream")).awaitTermination()
    log_sink.batch_writer(path, "events")(searches(_read(spark, sf, "events")), 0)
    rows = log_sink.read_log(spark, path).groupBy("user_id")
    found = rows.agg(F.count("*").alias("searches"), F.max("top_score").alias("top_score"), F.max("score_p50").alias("score_p50"), F.sum("result_count").alias("results"))
    return found.select("user_id", "searches", _r("top_score"), _r("score_p50"), "results")


def _requests(spark, sf):
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), "ts"
    )


DAY = 86_400


@_query
def rate_limit_window(spark, sf):
    return rate_limit.window_counts(_requests(spark, sf), DAY).select("request_id", "earlier")


@_query
def rate_limit_exact(spark, sf):
    return rate_limit.admitted(_requests(spark, sf), 1, DAY).select("request_id", "allowed")


@_query
def rate_limit_remaining(spark, sf):
    return rate_limit.remaining(rate_limit.admitted(_requests(spark, sf), 3, 10 * DAY), "2024-01-20 00:00:00", 3, 10 * DAY)
