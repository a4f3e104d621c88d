"""Interest in a topic over time: dated hits, months of activity, peaks and pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import by_score

HITS, THRESHOLD, PEAK = 50, 0.3, 0.5


def entries(scored: DataFrame, threshold: float = THRESHOLD, exclude_daily: bool = False, hits: int = HITS) -> DataFrame:
    """Of the best hits those with a date and a score of the threshold or more, oldest first."""
    first = scored.orderBy(*by_score("similarity")).limit(hits)
    if exclude_daily:
        first = first.filter(~F.array_contains("tags", "daily"))
    return first.filter(F.col("date").isNotNull() & (F.col("similarity") >= threshold)).orderBy("date", "doc_id")


def monthly(found: DataFrame) -> DataFrame:
    """month, intensity (mean similarity) and activity (count)."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    return found.groupBy(month).agg(F.avg("similarity").alias("intensity"), F.count("*").alias("activity"))


def peaks(months: DataFrame, least: float = PEAK) -> DataFrame:
    return months.filter(F.col("intensity") >= least).orderBy(F.desc("intensity"), "month")


def dormant(months: DataFrame) -> DataFrame:
    """Months between the first and the last active one without an entry."""
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a IS NOT NULL")
    first, last = (F.to_date(F.concat(c, F.lit("-01"))) for c in (F.col("a"), F.col("b")))
    span = ends.select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("m"))
    return span.select(F.date_format("m", "yyyy-MM").alias("month")).join(months.select("month"), "month", "left_anti")


def bars(months: DataFrame, width: int = 80) -> DataFrame:
    """month and a bar of its activity; no rows for under 10 files or under 3 months."""
    size = width - 30
    most = months.agg(F.max("activity").alias("most"), F.sum("activity").alias("all"), F.count("*").alias("months"))
    filled = F.floor(F.col("activity") / F.col("most") * size).cast("int")
    shown = months.crossJoin(F.broadcast(most)).filter("all >= 10 AND months >= 3").withColumn("f", filled)
    return shown.select("month", F.concat(F.expr("repeat('=', f)"), F.expr(f"repeat('-', {size} - f)")).alias("bar"))


def strongest(found: DataFrame, k: int = 20) -> DataFrame:
    return found.orderBy(*by_score("similarity")).limit(k)
