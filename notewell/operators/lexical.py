"""BM25 (Okapi) over postings, as grouped aggregates and joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize, word_counts

K1, B, EPSILON = 1.5, 0.75, 0.25
TAG_BOOST = 5.0


def index_text(title: str = "title", tags: str = "tags", content: str = "content", description: Column | None = None) -> Column:
    """The title, the tags twice, the description twice, and the content."""
    named = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    twice = [] if description is None else [description, description]
    return F.concat_ws(" ", F.col(title), F.array_join(F.concat(named, named), " "), *twice, F.col(content))


@dataclass(frozen=True)
class LexicalIndex:
    """postings(doc_id, term, tf, dl), terms(term, df, idf) and corpus(n_docs, avgdl, avg_idf), one row."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def search(self, docs: DataFrame, query: str, limit: int | None = 10, allowed: DataFrame | None = None) -> DataFrame:
        return search(self, docs, query, limit, allowed=allowed)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")))


def counted_words(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """doc_id, dl (number of words) and words (array of term and tf) of each row; nothing is shuffled."""
    worded = docs.select(F.col(key).alias("doc_id"), tokenize(text).alias("_w"))
    return worded.select("doc_id", F.size("_w").alias("dl"), word_counts(F.col("_w")).alias("words"))


def build_index(docs: DataFrame, text: Column, key: str = "doc_id") -> LexicalIndex:
    """Words are counted once, each document's in its own row, and kept; statistics are aggregates of them. The key is
    that of a row: rows that repeat it are documents of their own."""
    counted = counted_words(docs, text, key).persist(StorageLevel.MEMORY_AND_DISK)
    postings = counted.select("doc_id", F.inline("words"), "dl")
    # One row. It fills the cache in one stage; stages that run at once would wait for each other's parts of it.
    found = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    size = docs.sparkSession.createDataFrame([tuple(found)], "n_docs long, avgdl double")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size)).select("term", "df", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    corpus = size.crossJoin(F.broadcast(raw.agg(F.avg("idf").alias("avg_idf"))))
    floored = raw.crossJoin(F.broadcast(corpus.select("avg_idf")))
    terms = floored.select("term", "df", F.when(F.col("idf") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("idf")).alias("idf"))
    return LexicalIndex(postings, terms, corpus)


def query_words(query: str) -> list[str]:
    return query.lower().split()


def scores(index: LexicalIndex, query: str) -> DataFrame:
    """doc_id and bm25 for documents with a word of the query; a repeated word counts each time."""
    spark = index.postings.sparkSession
    asked = Counter(query_words(query))
    words = spark.createDataFrame(sorted(asked.items()), "term string, times long")
    known = index.terms.select("term", "idf").join(F.broadcast(words), "term")  # a row for each word of the query at most
    hits = index.postings.join(F.broadcast(known), "term")
    hits = hits.crossJoin(F.broadcast(index.corpus.select("avgdl")))
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    return hits.groupBy("doc_id").agg(F.sum(part).alias("bm25"))


def matched_tags(tags: Column, words: Sequence[str]) -> Column:
    """Tags equal to a query word; only if there are none, for each word the first tag that holds it or is held by it."""
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    equal = F.array_sort(F.array_intersect(lowered, asked))
    near = F.flatten(F.transform(asked, lambda w: F.slice(F.filter(lowered, lambda t: F.contains(t, w) | F.contains(w, t)), 1, 1)))
    return F.when(F.size(equal) > 0, equal).otherwise(F.array_sort(F.array_distinct(near)))


def with_tag_boost(scored: DataFrame, query: str, boost: float = TAG_BOOST, score: str = "bm25", tags: str = "tags") -> DataFrame:
    """Adds bm25_base and tags_matched, and multiplies the score of rows with a matched tag; a boost up to 1 does nothing."""
    base = scored.withColumn("bm25_base", F.col(score))
    if boost <= 1:
        return base.withColumn("tags_matched", F.array().cast("array<string>"))
    out = base.withColumn("tags_matched", matched_tags(F.col(tags), query_words(query)))
    return out.withColumn(score, F.when(F.size("tags_matched") > 0, F.col(score) * boost).otherwise(F.col(score)))


def search(index: LexicalIndex, docs: DataFrame, query: str, limit: int | None = 10, boost: float = TAG_BOOST, allowed: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """The best documents: scores above min_score, tag boost, then the first `limit`.

    `allowed` (doc_id) restricts the answers after scoring, so that the statistics stay those of the corpus.
    """
    found = scores(index, query).filter(F.col("bm25") > min_score)
    if allowed is not None:
        found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
    boosted = with_tag_boost(found.join(docs, "doc_id"), query, boost)
    return boosted if limit is None else boosted.orderBy(F.desc(F.round("bm25", 9)), "doc_id").limit(limit)
