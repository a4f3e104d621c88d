"""Statistics of the search log. Rows with an error count nowhere but in `recent`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _good(log: DataFrame) -> DataFrame:
    return log.filter("error IS NULL")


def totals(log: DataFrame) -> DataFrame:
    return _good(log).agg(F.count("*").alias("searches"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def by_mode(log: DataFrame) -> DataFrame:
    return _good(log).groupBy(F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("searches"))


def timing(log: DataFrame) -> DataFrame:
    """Mean times in ms, rounded half to even; zeros without rows."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0))).cast("long")
    return _good(log).filter("total_ms IS NOT NULL").agg(mean("retrieval_ms").alias("avg_retrieval_ms"), mean("total_ms").alias("avg_total_ms"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def score_summary(results: DataFrame, search: str = "search_id") -> DataFrame:
    """Per search: top_score, and score_p50 if there are two results or more. The strongest kind of score counts."""
    score = F.coalesce("cross_encoder", "rrf", "similarity", "bm25")
    scored = results.withColumn("_s", score)
    return scored.groupBy(search).agg(
        F.max("_s").alias("top_score"),
        F.when(F.count("_s") >= 2, F.median("_s")).alias("score_p50"),
        F.count("*").alias("results"),
    )
