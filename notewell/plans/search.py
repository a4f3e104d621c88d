"""Search plans: each is one lazy DataFrame from corpus to ranked rows, then an ordered list of stages over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import filters, fusion, lexical, ranking
from ..operators.block_postings import SavedIndex

OVERFETCH = 3


@dataclass(frozen=True)
class SearchParams:
    query: str
    mode: str = "hybrid"  # semantic, hybrid or bm25
    limit: int = 10
    min_score: float = 0.3
    rerank: bool = False
    rerank_candidates: int = 100
    time_boost: bool = True
    now: Column | str | None = None
    query_filter: filters.QueryFilter = field(default_factory=filters.QueryFilter)
    scorer: Callable[[str], Callable[[Column], Column]] = ranking.lexical_overlap  # of the second stage, by query

    @property
    def order(self) -> str:
        return {"semantic": "similarity", "hybrid": "rrf", "bm25": "bm25"}[self.mode]


def similarity(docs: DataFrame, query_vector: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds `similarity` to docs. query_vector: one row with column q; it is broadcast, docs are not shuffled."""
    return docs.crossJoin(F.broadcast(query_vector.limit(1).select("q"))).withColumn("similarity", cosine(vector, "q")).drop("q")


def semantic_topk(docs: DataFrame, query_vector: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest of the documents with a vector; `allowed` (doc_id) restricts them before any vector is scored."""
    rows = docs.filter(F.col("embedding").isNotNull())
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return fusion.top(similarity(rows, query_vector).filter("similarity IS NOT NULL"), "similarity", k)


def hybrid(
    docs: DataFrame,
    index: lexical.LexicalIndex | SavedIndex,
    query: str,
    query_vector: DataFrame,
    limit: int = 10,
    boosts: bool = True,
    allowed: DataFrame | None = None,
    nearest: Callable[[int], DataFrame] | None = None,
) -> DataFrame:
    """Both searches, reciprocal rank fusion, boosts, then the first `limit`.

    `allowed` (doc_id) restricts both searches. `nearest` gives doc_id and similarity of as many vectors as it is asked
    for, in place of a scan of the documents' vectors.

    Rows keep `similarity` (found late for keyword-only hits; 0.0 without a vector) and `bm25` (0.0 for others). A list
    is ranked after its cut to three times the limit, so that the windows hold a few rows each.
    """
    k = OVERFETCH * limit
    found = nearest(k) if nearest else semantic_topk(docs, query_vector, k, allowed)
    near = fusion.with_rank(found, "similarity", "similarity_rank")
    near = near.select("doc_id", "similarity_rank")
    words = index.search(docs.select("doc_id", "tags"), query, limit=k, allowed=allowed)
    words = fusion.with_rank(words, "bm25", "bm25_rank").select("doc_id", "bm25", "bm25_base", "tags_matched", "bm25_rank")
    merged = near.join(words, "doc_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (fusion.RRF_K + F.col(c)), F.lit(0.0))
    fused = merged.withColumn("rrf", part("similarity_rank") + part("bm25_rank"))
    if boosts:
        fused = fusion.boost_hybrid(fused)
    best = fusion.top(fused, "rrf", limit)
    rows = similarity(docs.join(F.broadcast(best), "doc_id"), query_vector)
    return rows.withColumns({"similarity": F.coalesce("similarity", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})


Stage = Callable[[DataFrame, SearchParams], DataFrame]


@dataclass(frozen=True)
class NamedStage:
    """A stage of a pipeline: it runs only where `applies` says so."""

    name: str
    run: Stage
    applies: Callable[[SearchParams], bool] = lambda params: True


def _time(rows: DataFrame, p: SearchParams) -> DataFrame:
    now = p.now if p.now is not None else F.current_timestamp()
    return ranking.time_boost(rows, now, p.order)


DEFAULT_STAGES: tuple[NamedStage, ...] = (
    NamedStage("score", lambda df, p: filters.min_score(df, p.min_score), lambda p: p.mode == "semantic"),
    NamedStage("status", lambda df, p: filters.visible(df)),
    NamedStage("query_filter", lambda df, p: filters.apply_filter(df, p.query_filter), lambda p: bool(p.query_filter.steps())),
    NamedStage("rerank", lambda df, p: ranking.rerank(df, p.order, p.scorer(p.query), p.limit, p.rerank_candidates), lambda p: p.rerank),
    # Recency comes after the second stage and orders by the boosted first-stage score again.
    NamedStage("time_boost", _time, lambda p: p.time_boost),
    NamedStage("limit", lambda df, p: fusion.top(df, p.order, p.limit), lambda p: not p.rerank),
)


def run_stages(rows: DataFrame, params: SearchParams, stages: Sequence[NamedStage] = DEFAULT_STAGES) -> DataFrame:
    return reduce(lambda df, s: df.transform(s.run, params), [s for s in stages if s.applies(params)], rows)


@dataclass(frozen=True)
class StageCounts:
    """Rows before and after each stage, known once the rows have been computed."""

    names: tuple[str, ...]
    seen: tuple[Observation, ...]  # one more than there are stages

    def rows(self) -> list[tuple[str, int, int, int]]:
        """(stage, position, before_count, after_count); waits for the run that computes the rows."""
        n = [x.get.get("n", 0) for x in self.seen]
        return [(name, i, n[i], n[i + 1]) for i, name in enumerate(self.names)]


def run_observed(rows: DataFrame, params: SearchParams, stages: Sequence[NamedStage] = DEFAULT_STAGES) -> tuple[DataFrame, StageCounts]:
    """As run_stages, with counters between the stages that the run of the rows itself fills."""
    applied = [s for s in stages if s.applies(params)]
    seen = tuple(Observation() for _ in range(len(applied) + 1))
    out = rows.observe(seen[0], F.count(F.lit(1)).alias("n"))
    for s, after in zip(applied, seen[1:]):
        out = out.transform(s.run, params).observe(after, F.count(F.lit(1)).alias("n"))
    return out, StageCounts(tuple(s.name for s in applied), seen)


def stage_counts(rows: DataFrame, params: SearchParams, stages: Sequence[NamedStage] = DEFAULT_STAGES) -> DataFrame:
    """stage, position, before_count and after_count of each stage that applies, from one run of the stages."""
    out, counts = run_observed(rows, params, stages)
    out.write.format("noop").mode("overwrite").save()
    return rows.sparkSession.createDataFrame(counts.rows(), "stage string, position int, before_count long, after_count long")
