"""A vector table with a coded copy: eight bits for each component, and a bound of the error that this makes.

A code c with scale s stands for the unit vector u; e = |u - s c| is stored beside it. For a unit query q the cosine lies
within e of s c.q, so a scan of the codes, a quarter of the vectors' bytes or less, leaves few rows whose vectors are read:
those that may reach the k-th highest lower bound. The answer is that of the exact scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, norm
from .fusion import top

LEVELS = 127
SLACK = 1e-7  # of sums of products in another order


def save(docs: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", buckets: int = 32) -> None:
    """Writes codes (key, scale, error, code) and vectors (key, vector) under path, both in ranges of the key.

    Vectors that are null, zero or not finite have no code: no search finds them.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("n", norm("v"))
    rows = rows.filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    unit = rows.withColumn("u", F.transform("v", lambda x: x / F.col("n")))
    scaled = unit.withColumn("scale", F.array_max(F.transform("u", F.abs)) / LEVELS)
    coded = scaled.withColumn("code", F.transform("u", lambda x: F.round(x / F.col("scale")).cast("tinyint")))
    miss = F.zip_with("u", "code", lambda x, c: x - c * F.col("scale"))
    coded = coded.select("doc_id", "scale", norm(miss).alias("error"), "code")
    for name, table in (("codes", coded), ("vectors", docs.select(F.col(key).alias("doc_id"), F.col(vector).alias("vector")))):
        dealt = table.repartitionByRange(buckets, "doc_id").sortWithinPartitions("doc_id")
        dealt.write.mode("overwrite").parquet(f"{path}/{name}")


def bounded(codes: DataFrame, query: DataFrame) -> DataFrame:
    """doc_id and the least and highest cosine that its code allows. query: one row with a column q; it is broadcast."""
    unit = query.limit(1).select(F.col("q").cast("array<double>").alias("q")).withColumn("n", norm("q"))
    unit = unit.filter("n > 0").select(F.transform("q", lambda x: x / F.col("n")).alias("q"))
    near = codes.crossJoin(F.broadcast(unit)).filter(F.size("code") == F.size("q"))
    about = dot("code", "q") * F.col("scale")
    off = F.col("error") + SLACK
    return near.select("doc_id", (about - off).alias("low"), (about + off).alias("high"))


def search(spark: SparkSession, path: str, query: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """doc_id and similarity of the k nearest; `allowed` (doc_id) restricts them before any code is read."""
    codes = spark.read.parquet(f"{path}/codes")
    if allowed is not None:
        codes = codes.join(allowed.select("doc_id"), "doc_id", "left_semi")
    bounds = bounded(codes, query)
    lows = [r[0] for r in bounds.orderBy(F.desc("low")).limit(k).select("low").collect()]
    few = bounds.filter(F.col("high") >= F.lit(lows[-1])) if len(lows) == k else bounds
    rows = spark.read.parquet(f"{path}/vectors").join(few.select("doc_id"), "doc_id", "left_semi")
    exact = rows.crossJoin(F.broadcast(query.limit(1).select("q"))).withColumn("similarity", cosine("vector", "q"))
    return top(exact.filter("similarity IS NOT NULL").select("doc_id", "similarity"), "similarity", k)
