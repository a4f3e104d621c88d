"""Weighted rendezvous sharding of stable record keys (DataFrame functions only).

Every (key, shard) pair has one fixed pseudo-random number u in (0, 1); a record goes to the shard with the least
-ln(u) / weight. A shard's share is its weight over the sum of weights, and a shard that is added takes over exactly
the records for which it is now the least, so nothing else moves. No shuffle is needed to assign a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

HASH_DIGITS = 13  # hexadecimal digits of md5 that make the number u: 52 bits


def _unit(seed: str, key: Column, shard: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(f":{shard}")).cast("binary")), 1, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """Shard number for each key; ties go to the lower shard, shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative and one must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    costs = [
        F.struct((-F.ln(_unit(seed, text, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*costs))["shard"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    grown_weights: Sequence[float] | None = None,
    seed: str = "shard",
) -> DataFrame:
    """Adds `shard`, and `grown_shard` for a second list of weights.

    Null keys are one key, the empty text. Columns of these two names are replaced, others of any name stay; texts are not
    read, so their length does not matter; an empty table stays empty, and repeated rows go to one shard.
    """
    out = docs.withColumn("shard", rendezvous(F.col(key), weights, seed))
    if grown_weights is None:
        return out
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown_weights, seed))


def number_slots(sharded: DataFrame, key: str = "doc_id", ties: Sequence[str] = (), cells: int = 256, hot_rows: int = 1_000_000) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard; nulls come first.

    A shard can hold any number of rows, so no task sorts a whole shard: rows are numbered within cells of a shard (by a
    hash of key and ties), and each cell starts where the ones before it end. The table of cell sizes has at most
    shards x 16 x cells rows. Rows that agree in key and ties get a slot each, in any order among them; hot_rows or more of
    them (null keys, say) are no part of a cell: they follow the cells of their shard, numbered within each partition of
    the input. Key and ties may be null. A column `slot` is replaced, others of any name stay; an empty table stays empty.
    """
    own = [c for c in sharded.columns if c != "slot"]
    text = F.concat_ws(":", *[F.coalesce(F.xxhash64(F.col(c)).cast("string"), F.lit("")) for c in ties])
    text = F.concat(F.lit("cell:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), text)
    width = max(1, len(f"{cells - 1:x}"))
    # Columns of the input stand in `row`, so that no name can clash. The part is written, not found again by each reader.
    rows = materialize(
        sharded.select(
            F.struct(*[F.col(c) for c in own]).alias("row"),
            F.col("shard").alias("shard"),
            F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate([key, *ties])]).alias("by"),
            F.substring(F.md5(text.cast("binary")), 1, width).alias("cell"),
            F.spark_partition_id().alias("part"),
        ),
        "slots",
    )
    same = ["shard", "by"]
    counted = materialize(rows.groupBy("shard", "cell").agg(F.count("*").alias("n")), "cells")
    large = counted.filter(F.col("n") >= hot_rows).select("shard", "cell")
    groups = rows.join(F.broadcast(large), ["shard", "cell"]).groupBy(*same, "cell").agg(F.count("*").alias("n"))
    hot = materialize(groups.filter(F.col("n") >= hot_rows), "hot-slots")
    before = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = rows.join(F.broadcast(hot.select(*same, F.lit(True).alias("hot"))), same, "left")
    warm, cold = marked.filter("hot"), marked.filter("hot IS NULL")
    taken = hot.groupBy("shard", "cell").agg(F.sum("n").alias("taken"))
    sizes = counted.join(taken, ["shard", "cell"], "left").select("shard", "cell", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
    starts = sizes.select("shard", "cell", before(["shard"], "cell").alias("start"))
    placed = cold.withColumn("nth", F.row_number().over(W.partitionBy("shard", "cell").orderBy("by"))).join(F.broadcast(starts), ["shard", "cell"])
    # At most one hot row for each hot_rows rows of the input, so these windows of a shard are short.
    ends = sizes.groupBy("shard").agg(F.sum("n").alias("cold"))
    firsts = hot.join(ends, "shard", "left").select(*same, (F.coalesce("cold", F.lit(0)) + before(["shard"], "by")).alias("first"))
    parts = warm.groupBy(*same, "part").agg(F.count("*").alias("n"))
    spread = parts.select(*same, "part", before(same, "part").alias("skipped")).join(firsts, same)
    spread = spread.select(*same, "part", (F.col("first") + F.col("skipped")).alias("start"))
    late = warm.withColumn("nth", F.row_number().over(W.partitionBy(*same, "part").orderBy(F.lit(0)))).join(spread, [*same, "part"])
    numbered = placed.select("row", "start", "nth").unionByName(late.select("row", "start", "nth"))
    return numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in own], (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
