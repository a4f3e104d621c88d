"""Keeping an index in step with its files: change sets, keyed merges, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent


def changes(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """relative_path and change_type (new, modified, deleted) from two tables of relative_path and modified."""
    now = current.select("relative_path", F.col("modified").alias("_now"), F.lit(True).alias("_here"))
    then = tracked.select("relative_path", F.col("modified").alias("_then"), F.lit(True).alias("_known"))
    kind = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_here").isNull(), "deleted")
        .when(~F.col("_now").eqNullSafe(F.col("_then")), "modified")
    )
    both = now.join(then, "relative_path", "full_outer").withColumn("change_type", kind)
    return both.filter("change_type IS NOT NULL").select("relative_path", "change_type")


def merge(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without any row of a changed path, and the fresh rows of new and modified ones."""
    kept = index.join(changed.select("relative_path"), "relative_path", "left_anti")
    added = fresh.join(changed.filter("change_type != 'deleted'").select("relative_path"), "relative_path", "left_semi")
    return kept.unionByName(added)


def without_stale(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("relative_path"), "relative_path", "left_semi")


def index_stats(index: DataFrame) -> DataFrame:
    """num_items, avg_content_length, unique_tags and directories, one row."""
    tags = index.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("unique_tags"))
    rest = index.agg(
        F.count("*").alias("num_items"),
        F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("avg_content_length"),
        F.countDistinct(parent("relative_path")).alias("directories"),
    )
    return rest.crossJoin(F.broadcast(tags))


def summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("items"),
        F.count_if("is_chunk").alias("chunks"),
        F.countDistinct("relative_path").alias("files"),
    )
