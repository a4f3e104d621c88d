"""The search log: an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_rows(searches: DataFrame, results: str = "results") -> DataFrame:
    """Searches with top_score, score_p50 (two results or more) and their results as JSON.

    results: array of structs with path and score.
    """
    scores = F.sort_array(F.transform(F.col(results), lambda r: r["score"]))
    n = F.size(scores)
    middle = (F.get(scores, F.floor((n - 1) / 2).cast("int")) + F.get(scores, F.floor(n / 2).cast("int"))) / 2
    return searches.withColumns(
        {
            "top_score": F.array_max(scores),
            "score_p50": F.when(n >= 2, middle),
            "result_count": n,
            "results_json": F.to_json(results),
        }
    ).drop(results)


def append(searches: DataFrame, path: str) -> None:
    log_rows(searches).write.mode("append").parquet(path)
