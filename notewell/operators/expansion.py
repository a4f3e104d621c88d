"""Query expansion by pseudo-relevance feedback: TF-IDF terms of the best results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEEDS, TERMS, FEATURES, MAX_WORDS = 5, 3, 100, 3

# Common English function words.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he "
    "her here his how i if in into is it its just like me more most my no not of on only or other our out over she so "
    "some such than that the their them then there these they this to up was we were what when where which who will "
    "with would you your"
).split()


def wants_expansion(query: str, seeds: int, least: int = SEEDS) -> bool:
    return len(query.split()) < MAX_WORDS and seeds >= least


def expansion_terms(seeds: DataFrame, query: str, text: str = "content", terms: int = TERMS) -> DataFrame:
    """term and weight: the mean over seeds of L2-normalised TF-IDF of words and word pairs, the best few.

    Words have two letters or more and are no stop words; the 100 most frequent terms take part. Ties go by the alphabet.
    Terms that the query holds are dropped after the cut.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    rows = seeds.select("doc_id", kept.alias("_w"))
    pairs = F.expr("transform(slice(_w, 1, greatest(size(_w) - 1, 0)), (w, i) -> concat(w, ' ', _w[i + 1]))")
    each = rows.select("doc_id", F.explode(F.concat("_w", pairs)).alias("term"))
    tf = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    frequent = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    frequent = frequent.orderBy(F.desc("total"), "term").limit(FEATURES)
    n = seeds.agg(F.count("*").alias("n"))
    weighed = tf.join(F.broadcast(frequent), "term").crossJoin(F.broadcast(n))
    weighed = weighed.withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    unit = weighed.withColumn("u", F.col("w") / length)
    best = unit.groupBy("term").agg((F.sum("u") / F.first("n")).alias("weight"))
    best = best.orderBy(F.desc(F.round("weight", 9)), "term").limit(terms)
    return best.filter(~F.contains(F.lit(query.lower()), F.col("term")))


def expand(query: str, seeds: DataFrame, text: str = "content") -> str:
    """The query with its expansion terms; two small jobs, since the words come from the data."""
    best = seeds.limit(SEEDS)
    if not wants_expansion(query, best.count()):
        return query
    return " ".join([query, *[r["term"] for r in expansion_terms(best, query, text).orderBy(F.desc(F.round("weight", 9)), "term").collect()]])
