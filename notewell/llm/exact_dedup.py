"""Exact copies: rows grouped by a 128-bit hash of their normalised text, compared byte by byte (DataFrame functions only).

Narrow rows (id, hash, digest) are grouped with a map-side combine, so a group of any size is one row per task. Of the
hashes that several rows share, the texts themselves are grouped by (hash, bytes), again combined before the shuffle: a
hash with two different texts is a collision, and its rows are then grouped by their bytes instead of their hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, join_counted, materialize

# Runs of blanks that are not one space already; replacing them by a space is replacing every run of blanks.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BROADCAST_HASHES = 1_000_000  # of 16 bytes each


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks is one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the groups of several rows: key, least id, the row that stays, number of rows."""
    groups = rows.groupBy(*key).agg(
        F.min("doc_id").alias("_keep"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("_first"),
        F.count("*").alias("_n"),
    )
    return materialize(groups.filter("_n > 1"), "copies")


def _decided(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    found = join_counted(rows, groups, key, "_n", total)
    alone = F.col("_n").isNull()
    return found.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("_first"))).alias("kept"),
    )


def exact_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = hash128
) -> DataFrame:
    """One row per row of docs: doc_id, digest (SHA-256 of the normalised text), keep_id, group_size, kept.

    Texts are equal if their normalised bytes are. Of equal texts the row with the least id stays, a null id last, and one
    row of those that repeat it. Null, empty and blank texts are texts like others: null and empty ones are equal, a
    blank one is a single space. Texts of any length are taken whole; an empty table gives no row; other columns are not
    read. The result is materialized.
    """
    norm = normalised(F.col(text))
    texts = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm")).withColumn("key", digest(F.col("norm")))
    keyed = texts.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    rows = materialize(keyed.select("doc_id", "key", "digest", F.monotonically_increasing_id().alias("row")), "hashes")
    total = rows.count()
    groups = _groups(rows, ["key"])
    shared = groups.select("key")
    several = texts.select("key", "norm")
    if shared.count() <= BROADCAST_HASHES:  # else all texts are grouped, which moves each of them once
        several = several.join(F.broadcast(shared), "key", "left_semi")
    variants = several.groupBy("key", "norm").agg(F.count("*").alias("_n"))
    collided = materialize(variants.groupBy("key").agg(F.count("*").alias("_v")).filter("_v > 1").select("key"), "collided")
    scratch = [rows, groups, collided]
    if not collided.limit(1).count():
        decided = _decided(rows, groups, ["key"], total)
    else:
        split = keyed.join(collided, "key", "left_semi").withColumn("row", F.monotonically_increasing_id())
        split = materialize(split, "collisions")
        exact = _groups(split, ["key", "norm"])
        decided = _decided(rows.join(collided, "key", "left_anti"), groups, ["key"], total)
        decided = decided.union(_decided(split, exact, ["key", "norm"], total))
        scratch += [split, exact]
    out = materialize(decided, "decided")
    drop_scratch(*scratch)
    return out


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_copies.

    Of rows that repeat an id and a text with other columns, the one with the least hash of its columns stays, whatever
    the order of the rows. Columns of docs may have any name.
    """
    decided = exact_copies(docs, doc_id, text)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    ids = [F.col("doc_id").alias("_i"), F.col("digest").alias("_d")]
    gone = decided.filter(~same).select(*ids).distinct()
    repeated = decided.filter(same).groupBy(*ids).agg(F.count("*").alias("_n")).filter("_n > 1").select("_i", "_d")
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), digest.alias("_key"))
    at = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_d"))
    rows = rows.join(gone, at, "left_anti")
    least = F.min_by("_row", F.xxhash64(F.to_json("_row")))
    once = rows.join(repeated, at, "left_semi").groupBy("_id", "_key").agg(least.alias("_row")).select("_row")
    return rows.join(repeated, at, "left_anti").select("_row").union(once).select("_row.*")
