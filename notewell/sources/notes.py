"""Notes: Markdown files of a vault, and the supplied tables seen as notes."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_markdown, stem, strip, valid_text

SKIPPED_DIRS = ("Utilities", ".venv", "node_modules")
HEAD = r"(?s)^---\n(.*?)\n---\n?(.*)$"


def discover(files: DataFrame, patterns: Sequence[str] = (), path: str = "relative_path") -> DataFrame:
    """Paths of notes: .md and .txt, no hidden or skipped folder, none of the further patterns; in component order."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_DIRS))
    rows = files.filter(F.col(path).rlike(r"\.(md|txt)$")).filter(~hidden)
    for p in patterns:
        rows = rows.filter(~F.contains(F.col(path), F.lit(p)))
    return rows.orderBy(parts)


def read_vault(spark: SparkSession, root: str, patterns: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """relative_path, raw, modified of a vault's notes, or of the first `limit` of them, read by Spark's binary source."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    )
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), f"^{base}/", "")
    rows = found.select(path.alias("relative_path"), valid_text("content").alias("raw"), F.col("modificationTime").alias("modified"))
    rows = discover(rows, patterns)
    return rows if limit is None else rows.limit(limit)


def split_frontmatter(text: Column | str) -> Column:
    """struct(head, body): the YAML block at the very start, null without one."""
    c = F.col(text) if isinstance(text, str) else text
    has = c.rlike(HEAD)
    return F.struct(
        F.when(has, F.regexp_extract(c, HEAD, 1)).alias("head"),
        F.when(has, F.regexp_extract(c, HEAD, 2)).otherwise(c).alias("body"),
    )


_TEXTS = T.ArrayType(T.StringType())
HEAD_SCHEMA = T.StructType(
    [T.StructField(n, _TEXTS if n in ("tags", "types") else T.StringType()) for n in ("title", "tags", "types", "status", "description", "created", "properties")]
)


@F.pandas_udf(HEAD_SCHEMA)
def parse_head(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Arbitrary YAML has no built-in reader: heads are parsed by batches in Python."""
    import yaml

    def strings(v) -> list[str] | None:
        if v is None:
            return None
        values = v if isinstance(v, list) else [v]
        return list(dict.fromkeys(str(x) for x in values if x is not None))

    def one(head: str | None) -> dict:
        try:
            found = yaml.safe_load(head) if head else {}
        except yaml.YAMLError:
            found = {}
        found = found if isinstance(found, dict) else {}
        plain = lambda k: None if found.get(k) is None else str(found[k])
        return {
            "title": plain("title"),
            "tags": strings(found.get("tags")),
            "types": strings(found.get("type")),
            "status": plain("status"),
            "description": plain("description"),
            "created": plain("created"),
            "properties": json.dumps({str(k): str(v) for k, v in found.items() if v is not None}),
        }

    for batch in heads:
        yield pd.DataFrame([one(h) for h in batch], columns=HEAD_SCHEMA.names)


def read_notes(files: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Notes from relative_path, raw and modified: title, tags, content (description first, then the cleaned body) and
    frontmatter, all of the head's values as text by name."""
    parsed = files.withColumn("_s", split_frontmatter("raw")).withColumn("_h", parse_head("_s.head"))
    content = F.concat(F.coalesce(F.concat(F.col("_h.description"), F.lit(". ")), F.lit("")), clean_markdown(F.col("_s.body")))
    notes = parsed.select(
        "relative_path",
        F.coalesce("_h.title", stem("relative_path")).alias("title"),
        content.alias("content"),
        F.coalesce("_h.tags", F.array().cast("array<string>")).alias("tags"),
        F.col("_h.types").alias("types"),
        F.col("_h.status").alias("status"),
        F.col("_h.created").alias("created"),
        F.col("_h.description").alias("description"),
        F.from_json("_h.properties", "map<string, string>").alias("frontmatter"),
        "modified",
    )
    return notes if keep_blank else notes.filter(strip("content") != "")


# Per folder: label, a path part that is needed, parts that must be absent, how many, and whether the last ones.
SUBSETS = (
    ("daily", "/Daily/", (), 50, True),
    ("tech", "/Reference/Tech/", (), 40, False),
    ("culture", "/Reference/Culture/", (), 30, False),
    ("letters", "/L/", ("/Daily/",), 50, False),
    ("reference", "/Reference/", ("/Tech/", "/Culture/"), 30, False),
)


def strategic_subset(files: DataFrame, subsets=SUBSETS, path: str = "relative_path") -> DataFrame:
    """path and subset: some files of each folder; a file can be in several.

    Each subset is a top-n of its own: tasks keep as many paths as the subset wants, and only those are shuffled.
    """
    full, parts = F.concat(F.lit("/"), F.col(path)), F.split(path, "/")
    found = []
    for name, part, absent, most, newest in subsets:
        rows = files.filter(F.contains(full, F.lit(part)))
        for a in absent:
            rows = rows.filter(~F.contains(full, F.lit(a)))
        rows = rows.orderBy(parts.desc() if newest else parts).limit(most)
        found.append(rows.select(path, F.lit(name).alias("subset")))
    return reduce(DataFrame.union, found)


_SIDES = ("labels", "events", "embeddings")


def note_table(spark: SparkSession, sf_dir: str, sides: Sequence[str] = _SIDES) -> DataFrame:
    """The supplied tables as notes: documents with status (labels), change time (events) and vector (embeddings).

    Each of these has one row for an id at most. Of `sides` that are left out the column is missing, and the texts are
    not joined with them.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = F.array("lang", "source")
    rows, more = read("documents"), {}
    if "labels" in sides:
        rows = rows.join(read("labels").select("doc_id", "toxic", "quality", F.lit(True).alias("_l")), "doc_id", "left")
        more["status"] = F.when(F.col("toxic") == 1, "hidden").when(F.col("quality") == 0, "inactive").when(F.col("_l"), "active")
    if "events" in sides:
        rows = rows.join(read("events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("modified")), "doc_id", "left")
        more["modified"] = F.col("modified")
    if "embeddings" in sides:
        rows = rows.join(read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        more["embedding"] = F.col("embedding")
    return rows.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(base, F.array(F.lit("daily")))).otherwise(base).alias("tags"),
        F.array("lang").alias("types"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("frontmatter"),
        *[c.alias(name) for name, c in more.items()],
    )
