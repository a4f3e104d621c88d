"""Overlapping chunks of long texts, by their closed form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


@dataclass(frozen=True)
class ChunkRules:
    size: int = 2000
    overlap: int = 400
    threshold: int = 4000

    def __post_init__(self) -> None:
        if self.size < 2 or not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be less than the size, and the size 2 or more")


def chunk(rows: DataFrame, rules: ChunkRules = ChunkRules(), text: str = "content") -> DataFrame:
    """One row per chunk: the columns of rows with text cut, and chunk_index, chunk_total, chunk_start, chunk_end, is_chunk.

    Windows of `size` begin every size - overlap characters; the last one takes the rest, so that none is shorter than
    half a window. Texts under the threshold are one chunk; blank texts give none.
    """
    step = rules.size - rules.overlap
    n = F.length(text)
    many = F.greatest(F.lit(1), F.floor((n - rules.size // 2) / step).cast("int") + 1)
    total = F.when((n < rules.threshold) | (n <= rules.size), 1).otherwise(many).cast("int")
    counted = rows.filter(strip(text) != "").withColumn("chunk_total", total).withColumn("_n", n)
    each = counted.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    start = F.col("chunk_index") * step
    last = F.col("chunk_index") == F.col("chunk_total") - 1
    return (
        each.withColumn("chunk_start", start.cast("int"))
        .withColumn("chunk_end", F.when(last, F.col("_n")).otherwise(F.least(start + rules.size, F.col("_n"))).cast("int"))
        .withColumn("is_chunk", F.col("chunk_total") > 1)
        .withColumn(text, F.substring(F.col(text), F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start")))
        .drop("_n")
    )


def statistics(chunks: DataFrame, text: str = "content", end: str = "chunk_end") -> DataFrame:
    """One row of counts and sizes; zeros for no chunks."""
    n = F.length(text)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(
        F.count("*").alias("num_chunks"),
        zero(F.avg(n)).alias("avg_chunk_size"),
        zero(F.min(n)).alias("min_chunk_size"),
        zero(F.max(n)).alias("max_chunk_size"),
        zero(F.max(end)).alias("total_content_size"),
        zero(F.avg(F.floor(n / 4))).alias("avg_estimated_tokens"),
    )
