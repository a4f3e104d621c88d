"""One vault from files to answers: index, search, topics and statistics over versioned Parquet tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.encoders import Encoder, batch_encoder, hashed_words
from .operators import block_postings, chunking, expansion, filters, fusion, lexical, maintenance, ranking, topics, vector_codes
from .plans import search
from .sources import notes, query_log
from .sources.snapshots import SnapshotStore


@dataclass(frozen=True)
class Answer:
    """The rows of one search, what its stages kept (stage, position, before, after), and the milliseconds it took."""

    rows: list[Row]
    stages: list[tuple[str, int, int, int]]
    total_ms: float


class NoteEngine:
    """Rows, keyword index and vector codes of a vault, all under one version of a SnapshotStore."""

    def __init__(self, spark: SparkSession, vault_path: str, index_path: str, vault: str = "vault", encoder: Encoder | None = None, rules: chunking.ChunkRules = chunking.ChunkRules(), model: str = "hashed-words"):
        self.spark, self.vault_path, self.index_path, self.vault, self.rules = spark, vault_path, index_path.rstrip("/"), vault, rules
        self.encoder, self.model = encoder or batch_encoder(hashed_words()), model
        self.store = SnapshotStore(spark, self.index_path, vault)

    # Index ---------------------------------------------------------------------------------------------------------

    def _rows(self, found: DataFrame) -> DataFrame:
        chunks = chunking.chunk(found, self.rules)
        keyed = chunks.withColumn("doc_id", F.xxhash64("relative_path", "chunk_index"))
        return keyed.withColumn("embedding", self.encoder(F.col("content")))

    def _tables(self) -> dict:
        text = lexical.index_text(description=F.col("description"))
        return {"lexical": lambda rows, path: block_postings.save(rows, text, path), "vectors": vector_codes.save}

    def reindex(self, force: bool = False) -> dict[str, int]:
        """Builds the index, or rewrites the buckets of changed files; without changes nothing is written."""
        self.store.guard(force)
        current = notes.read_notes(notes.read_vault(self.spark, self.vault_path))
        known = None if force else self.store.version()
        if known is None:
            made = self.store.replace(self._rows(current), self._tables(), {"model": self.model})
            return {"new": self.store.rows(made).select("relative_path").distinct().count()}
        old = self.store.rows(known).select("relative_path", "modified").distinct()
        changed = maintenance.changes(current.select("relative_path", "modified"), old).persist()
        try:
            counts = {r["change_type"]: r["count"] for r in changed.groupBy("change_type").count().collect()}
            if counts:
                fresh = current.join(changed.select("relative_path"), "relative_path", "left_semi")
                self.store.merge(changed, self._rows(fresh), self._tables())
        finally:
            changed.unpersist()  # else a later call could be answered with the files of this one
        return counts

    def rows(self) -> DataFrame:
        return self.store.rows()

    def stats(self) -> DataFrame:
        return maintenance.index_stats(self.rows())

    # Search --------------------------------------------------------------------------------------------------------

    def _vector(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query,)], "t string").select(self.encoder(F.col("t")).alias("q"))

    def _first(self, params: search.SearchParams, k: int) -> DataFrame:
        """The first k rows; paths and names to include restrict the search itself, not its answer."""
        version = self.store.version()
        rows = self.store.rows(version)
        allowed = filters.allowed_files(rows, params.query_filter.paths.include, params.query_filter.files.include)
        vector = self._vector(params.query)

        def nearest(n: int) -> DataFrame:
            return vector_codes.search(self.spark, self.store.table("vectors", version), vector, n, allowed)

        if params.mode == "semantic":
            return rows.join(F.broadcast(nearest(k)), "doc_id")
        index = block_postings.SavedIndex.load(self.spark, self.store.table("lexical", version))
        if params.mode == "bm25":
            return index.search(rows, params.query, k, allowed=allowed)
        return search.hybrid(rows, index, params.query, vector, k, allowed=allowed, nearest=nearest)

    def _search(self, params: search.SearchParams, expand: bool) -> tuple[DataFrame, search.StageCounts | None]:
        if params.limit < 1 or not params.query.strip():
            raise ValueError("a search needs a query and a limit of one or more")
        if expand:
            seeds = self._first(replace(params, mode="semantic"), 2 * params.limit)
            params = replace(params, query=expansion.expand(params.query, seeds))
        order, counts = params.order, None
        found = fusion.best_per_file(self._first(params, 2 * params.limit), order)
        if params.mode != "bm25":
            found, counts = search.run_observed(found, params)
        ranked = ranking.envelope(fusion.top(found, order, params.limit, "relative_path"), order)
        out = ranked.select(
            "relative_path",
            "title",
            "tags",
            "status",
            order,
            "scores",
            "matched_chunks",
            tx.snippet("content", params.query).alias("snippet"),
            tx.deep_link(self.vault, "relative_path").alias("uri"),
            tx.wiki_link("title").alias("wiki_link"),
        )
        return out, counts

    def search(self, params: search.SearchParams, expand: bool = False) -> DataFrame:
        """Ranked rows, best first, with links, snippet and score envelope. Twice the limit is fetched for the filters."""
        return self._search(params, expand)[0]

    def answer(self, params: search.SearchParams, expand: bool = False) -> Answer:
        """Runs a search once; its stages are counted by that run."""
        began = time.time()
        found, counts = self._search(params, expand)
        rows = found.collect()
        return Answer(rows, counts.rows() if counts else [], (time.time() - began) * 1000)

    def topic(self, query: str, threshold: float = 0.2, exclude_daily: bool = False) -> tuple[DataFrame, DataFrame]:
        """Entries and months of a topic."""
        scored = search.semantic_topk(self.rows(), self._vector(query), topics.HITS)
        dated = scored.withColumn("date", tx.note_date("relative_path", F.col("created"), F.col("modified")))
        found = topics.entries(dated, threshold, exclude_daily).persist()
        return found, topics.monthly(found)

    def log(self, params: search.SearchParams, answer: Answer, path: str, expand: bool = False) -> None:
        """Appends one search to the log."""
        hits = [(r["relative_path"], r[params.order]) for r in answer.rows]
        facts = (uuid.uuid4().hex, params.query, params.mode, self.vault, params.limit, params.rerank, expand, self.model, answer.total_ms, None)
        row = self.spark.createDataFrame(
            [(*facts, [(name, before, after) for name, _, before, after in answer.stages], hits)],
            "id string, query string, mode string, vault string, limit int, rerank boolean, expand_query boolean, model string, total_ms double, error string, "
            "pipeline_stages array<struct<stage:string,before_count:long,after_count:long>>, results array<struct<path:string,score:double>>",
        )
        query_log.append(row.withColumn("ts", F.current_timestamp()).withColumn("retrieval_ms", F.col("total_ms")), path)
