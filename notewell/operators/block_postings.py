"""A keyword index on disk that a query reads in part.

Documents are dealt to cells by a hash of their id, some hundred to a cell. One row is a block: a term's postings within a
cell, with the highest part that any of them adds to a score. Blocks lie in shelves (folders) by a hash of their term, in
the order of term and cell, so a query opens the shelves of its words and skips all other row groups by their range of
terms. A cell's highest parts, summed over the words, bound the score of all its documents: the cells with the highest
bounds are scored first, and of the others only those whose bound reaches the k-th score found there.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folder
from .lexical import B, EPSILON, K1, TAG_BOOST, counted_words, matched_tags, query_words, with_tag_boost

SHELVES = 32
CELL_DOCS = 128
PART_CELLS = 16  # cells whose documents are grouped in one task
SHELF_CELLS = 1024  # cells of a shelf that one task writes
FIRST_CELLS = 2  # cells to score first, for each document that is wanted
SLACK = 1e-6  # sums of the same parts in another order differ by less
ROW_GROUP = str(1 << 20)
_SCHEMAS = {
    "terms": "term string, df long, raw_idf double, shelf int",
    "blocks": "term string, cell long, most double, postings array<struct<doc_id:long,tf:int,dl:int>>, shelf int",
}


def shelf_of(word: str, shelves: int) -> int:
    return zlib.crc32(word.encode()) % shelves


def cell_of(doc_id: Column | str, cells: Column | int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(cells) if isinstance(cells, int) else cells)


def save(docs: DataFrame, text: Column, path: str, key: str = "doc_id", shelves: int = SHELVES, cell_docs: int = CELL_DOCS) -> None:
    """Writes blocks, terms and corpus (one row) under path. The key names a row.

    Each text is tokenized once and its words are counted in its own row. The counted rows are shuffled by cell, PART_CELLS
    to a task whatever the size of the corpus, and the blocks once more by shelf and cell; a term of any frequency is
    dealt over several files.
    """
    spark = docs.sparkSession
    raw = f"{path}/postings"
    counted_words(docs.withColumn(key, F.col(key).cast("long")), text, key).write.mode("overwrite").option("compression", "zstd").parquet(raw)
    counted = spark.read.parquet(raw)
    size = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = size["n_docs"], size["avgdl"] or 0.0
    cells = max(1, math.ceil(n_docs / cell_docs))
    postings = counted.select(F.explode("words.term").alias("term"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(F.lit(n_docs) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    shelf = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(shelves)).cast("int").alias("shelf")
    terms = df.select("term", "df", idf.alias("raw_idf"), shelf)
    terms.repartitionByRange(shelves, "shelf", "term").sortWithinPartitions("shelf", "term").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/terms")
    avg_idf = spark.read.schema(_SCHEMAS["terms"]).parquet(f"{path}/terms").agg(F.avg("raw_idf")).first()[0]
    corpus = [(n_docs, float(avgdl), float(avg_idf or 0.0), cells, shelves)]
    spark.createDataFrame(corpus, "n_docs long, avgdl double, avg_idf double, cells long, shelves int").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(max(float(avgdl), 1e-9))))
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = counted.withColumn("cell", cell_of("doc_id", cells)).repartition(max(default, math.ceil(cells / PART_CELLS)), "cell")
    # Rows of a cell are together, so this groups within a task.
    blocks = placed.select("cell", "doc_id", "dl", F.inline("words")).groupBy("term", "cell").agg(
        F.max(part).alias("most"),
        F.sort_array(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("postings"),  # of a cell's documents at most
    )
    # Tasks by shelf and some of the cells: no more files than needed, and none that holds all of a frequent term.
    deals = math.ceil(cells / SHELF_CELLS)
    keyed = blocks.withColumn("shelf", shelf).repartition(max(default, shelves * deals), "shelf", F.pmod(F.col("cell"), F.lit(deals)))
    dealt = keyed.sortWithinPartitions("shelf", "term", "cell")
    dealt.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("shelf").parquet(f"{path}/blocks")
    Folder(spark, path).delete("postings")


@dataclass(frozen=True)
class SavedIndex:
    """An index as `save` has written it."""

    spark: SparkSession
    path: str
    n_docs: int
    avgdl: float
    avg_idf: float
    cells: int
    shelves: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SavedIndex:
        return cls(spark, path, *spark.read.parquet(f"{path}/corpus").first())

    def _of(self, table: str, words: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.path}/{table}")
        shelves = sorted({shelf_of(w, self.shelves) for w in words})
        return rows.filter(F.col("shelf").isin(shelves) & F.col("term").isin(words))

    def weights(self, query: str) -> dict[str, float]:
        """idf times the number of times, of the query's words that the index has."""
        asked = Counter(query_words(query))
        if not asked:
            return {}
        rows = self._of("terms", list(asked)).select("term", "raw_idf").collect()  # one row for each word at most
        return {r["term"]: asked[r["term"]] * (r["raw_idf"] if r["raw_idf"] >= 0 else EPSILON * self.avg_idf) for r in rows}

    def _weight(self, weights: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for item in weights.items() for x in item]), F.col("term"))

    def scores(self, weights: dict[str, float], cells: DataFrame | list[int] | None = None) -> DataFrame:
        """doc_id and bm25 of the documents with a word, in all cells or in those given."""
        if not weights:
            return self.spark.createDataFrame([], "doc_id long, bm25 double")
        rows = self._of("blocks", list(weights)).select("term", "cell", "postings")
        if isinstance(cells, list):
            rows = rows.filter(F.col("cell").isin(cells))
        elif cells is not None:
            rows = rows.join(cells.select("cell"), "cell", "left_semi")
        hits = rows.select(self._weight(weights).alias("w"), F.inline("postings"))
        length = K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl))
        return hits.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("bm25"))

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """cell and the highest score that any of its documents can have; reads no postings."""
        rows = self._of("blocks", list(weights)).select("term", "cell", "most")
        return rows.groupBy("cell").agg(F.sum(self._weight(weights) * F.col("most")).alias("bound"))

    def candidates(self, query: str, k: int) -> DataFrame:
        """doc_id and bm25 of all documents of the cells that may hold one of the best k.

        With a word of negative weight scores have no such bound, and all documents with a word are scored.
        """
        weights = self.weights(query)
        if not weights or min(weights.values()) < 0:
            return self.scores(weights)
        first = [r["cell"] for r in self.bounds(weights).orderBy(F.desc("bound"), "cell").limit(FIRST_CELLS * k).collect()]
        best = [r[0] for r in self.scores(weights, first).orderBy(F.desc("bm25")).limit(k).select("bm25").collect()]
        if len(best) < k:
            return self.scores(weights)
        return self.scores(weights, self.bounds(weights).filter(F.col("bound") >= best[-1] - SLACK))

    def search(self, docs: DataFrame, query: str, limit: int = 10, boost: float = TAG_BOOST, allowed: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
        """The first `limit` documents by score after the tag boost, as `lexical.search` gives them.

        A document that the boost lifts has a matching tag: those are scored whatever their bound. The rest of the first
        `limit` are among the best `limit` without a boost. `allowed` (doc_id) restricts the answers: only their cells
        are scored then, and the statistics stay those of the corpus.
        """
        weights = self.weights(query)
        if allowed is not None:
            cells = allowed.select(cell_of("doc_id", self.cells).alias("cell")).distinct()
            found = self.scores(weights, cells).join(allowed.select("doc_id"), "doc_id", "left_semi")
        else:
            found = self.candidates(query, limit)
            plain = found.orderBy(F.desc(F.round("bm25", 9)), "doc_id").limit(limit)
            if boost > 1 and weights:
                tagged = docs.filter(F.size(matched_tags(F.col("tags"), query_words(query))) > 0).select("doc_id")
                cells = tagged.select(cell_of("doc_id", self.cells).alias("cell")).distinct()
                lifted = self.scores(weights, cells).join(tagged, "doc_id", "left_semi")
                plain = plain.join(tagged, "doc_id", "left_anti").unionByName(lifted)
            found = plain
        boosted = with_tag_boost(docs.join(found.filter(F.col("bm25") > min_score), "doc_id"), query, boost)
        return boosted.orderBy(F.desc(F.round("bm25", 9)), "doc_id").limit(limit)
