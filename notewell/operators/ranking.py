"""Scores that reorder a result list: recency, second-stage ranking, envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .fusion import by_score

HALF_LIFE_DAYS, MAX_BOOST = 90, 0.2


def age_days(modified: Column, now: Column | str) -> Column:
    """Whole days of 24 hours; `now` is a column or the text of a timestamp."""
    now = F.lit(now) if isinstance(now, str) else now
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))
    return F.floor(seconds / 86400)


def time_boost(rows: DataFrame, now: Column | str, score: str, modified: str = "modified", half_life: float = HALF_LIFE_DAYS, most: float = MAX_BOOST) -> DataFrame:
    """Multiplies the score by 1 + most * 0.5 ** (days / half_life); rows without a change time keep theirs.

    Adds time_boost and original_score.
    """
    factor = 1 + most * F.pow(F.lit(0.5), age_days(F.col(modified), now) / half_life)
    out = rows.withColumn("original_score", F.col(score)).withColumn("time_boost", F.coalesce(factor, F.lit(1.0)))
    return out.withColumn(score, F.col(score) * F.col("time_boost"))


def lexical_overlap(query: str) -> Callable[[Column], Column]:
    """A deterministic second-stage scorer: the share of distinct query words in the text, plus a share of the text's."""
    words = sorted(set(query.lower().split()))

    def score(text: Column) -> Column:
        own = F.array_distinct(tokenize(text))
        both = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]).cast("array<string>")))
        return both / F.lit(float(max(1, len(words)))) + F.coalesce(F.try_divide(both, F.size(own)), F.lit(0.0))

    return score


def rerank(rows: DataFrame, order: str, scorer: Callable[[Column], Column], k: int, candidates: int = 100) -> DataFrame:
    """Scores the best `candidates` rows anew and keeps the best k. `scorer` may be a pandas UDF around a model."""
    first = rows.orderBy(*by_score(order)).limit(candidates)
    text = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.concat_ws(" ", "title", "relative_path"))
    scored = first.withColumn("cross_encoder", scorer(text).cast("double"))
    return scored.orderBy(*by_score("cross_encoder")).limit(k)


ENVELOPE = ("semantic", "bm25", "rrf", "cross_encoder", "time_boost", "final")


def envelope(rows: DataFrame, order: str) -> DataFrame:
    """Adds `scores`, a struct of all scores that the rows have; `final` is the one that orders them."""
    flat = {"semantic": "similarity", "bm25": "bm25", "rrf": "rrf", "cross_encoder": "cross_encoder", "time_boost": "time_boost", "final": order}
    fields = [
        (F.col(flat[name]).cast("double") if flat[name] in rows.columns else F.lit(None).cast("double")).alias(name) for name in ENVELOPE
    ]
    return rows.withColumn("scores", F.struct(*fields))


def score_of(name: str, flat: str) -> Column:
    """A score from the envelope, else from its flat column."""
    return F.coalesce(F.col("scores")[name], F.col(flat))
