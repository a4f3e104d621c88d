"""Ranked lists: ranks, reciprocal rank fusion, boosts, one row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
SCORE_ORDER = ("rrf", "similarity", "bm25")


def by_score(score: str, key: str = "doc_id") -> list[Column]:
    """Best first; near-ties, which differ by the order of summation only, go by key."""
    return [F.desc(F.round(score, 9)), F.col(key)]


def top(rows: DataFrame, score: str, k: int, key: str = "doc_id") -> DataFrame:
    return rows.orderBy(*by_score(score, key)).limit(k)


def with_rank(rows: DataFrame, score: str, rank: str, key: str = "doc_id") -> DataFrame:
    """Numbers a list that has been cut to its top: one task sorts it."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by_score(score, key))))


def rrf(lists: Sequence[tuple[DataFrame, str]], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """key and rrf, the sum of 1 / (k + rank) over lists (rows, score column). A key repeated in a list counts again."""
    ranked = [with_rank(rows, score, "_rank", key).select(key, "_rank") for rows, score in lists]
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(1.0 / (k + F.col("_rank"))).alias("rrf"))


def boost_hybrid(rows: DataFrame, bm25_rank: str = "bm25_rank", first: int = 10) -> DataFrame:
    """Boosts of a fused list, for the first ten of its keyword list.

    With matched tags the score becomes max(rrf) * (1.5 + 0.5 * bm25 / max(bm25)); a keyword-only hit without them
    gets max(rrf) * 0.95 * bm25 / max(bm25), which may be lower than before. Adds tag_boosted.
    """
    everything = W.partitionBy(F.lit(0))
    share = F.try_divide(F.col("bm25"), F.max("bm25").over(everything))
    early = F.coalesce(F.col(bm25_rank) <= first, F.lit(False))
    tagged = early & (F.coalesce(F.size("tags_matched"), F.lit(0)) > 0)
    alone = early & ~tagged & F.col("similarity_rank").isNull()
    most = F.max("rrf").over(everything)
    return rows.withColumns(
        {
            "rrf": F.when(tagged, most * (1.5 + 0.5 * share)).when(alone, most * 0.95 * share).otherwise(F.col("rrf")),
            "tag_boosted": tagged,
        }
    )


def best_per_file(chunks: DataFrame, score: str, path: str = "relative_path", order: str = "chunk_index") -> DataFrame:
    """The best chunk of each file, with matched_chunks and best_chunk_index."""
    file = W.partitionBy(path)
    ranked = chunks.withColumn("_r", F.row_number().over(file.orderBy(F.desc(F.round(score, 9)), order)))
    counted = ranked.withColumn("matched_chunks", F.count("*").over(file))
    return counted.filter("_r = 1").withColumn("best_chunk_index", F.col(order)).drop("_r")


def some_per_file(chunks: DataFrame, score: str, most: int = 3, path: str = "relative_path", order: str = "chunk_index") -> DataFrame:
    """Up to `most` chunks of each file."""
    ranked = F.row_number().over(W.partitionBy(path).orderBy(F.desc(F.round(score, 9)), order))
    return chunks.withColumn("file_rank", ranked).filter(F.col("file_rank") <= most)
