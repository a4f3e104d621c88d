"""Index tables on disk: a new folder for each version, and a manifest that names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class WrongOwner(Exception):
    """The index belongs to another vault."""


def save(index: DataFrame, path: str, vault: str, version: str) -> None:
    """Writes the rows first and the manifest last, so that a reader never sees half an index."""
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/v-{version}")
    size = spark.read.parquet(f"{path}/v-{version}").agg(F.count("*").alias("num_rows"), F.countDistinct("relative_path").alias("num_files"))
    row = size.select(F.lit(vault).alias("vault"), F.lit(version).alias("version"), "num_rows", "num_files")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.parquet(f"{path}/manifest").first()
    except Exception:  # no manifest, or one that cannot be read: nobody owns the folder
        return None
    return row.asDict() if row else None


def load(spark: SparkSession, path: str) -> DataFrame:
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no index in {path}")
    return spark.read.parquet(f"{path}/v-{found['version']}")


def guard(spark: SparkSession, path: str, vault: str, force: bool = False) -> None:
    """Refuses an index of another vault, unless forced; a folder without an owner passes."""
    found = manifest(spark, path)
    if found and found.get("vault") and found["vault"] != vault and not force:
        raise WrongOwner(f"the index in {path} belongs to {found['vault']}")


def vault_metadata(notes: DataFrame, vault: str) -> DataFrame:
    return notes.agg(F.lit(vault).alias("vault"), F.count("*").alias("files"), F.max("modified").alias("last_modified"))
