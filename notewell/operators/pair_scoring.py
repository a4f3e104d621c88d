"""A second stage that sees query and text together: any model as a scorer of pairs, and a small one fitted on judged pairs.

The small model puts three features of a pair into five bins each and adds the log odds of the bins. Its counts come from
one aggregate over all judged pairs, so it has 15 weights whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize

FEATURES, BINS = ("coverage", "phrases", "start"), 5
QUERY_WORDS = 5

PairModel = Callable[[pd.Series, pd.Series], np.ndarray]
_loaded: dict[object, PairModel] = {}


def _model(load: Callable[[], PairModel]) -> PairModel:
    """What load makes; a worker process keeps that of one load, as long as equal ones are asked for."""
    if load not in _loaded:
        _loaded.clear()
        _loaded[load] = load()
    return _loaded[load]


def pair_udf(load: Callable[[], PairModel]) -> Callable[[Column, Column], Column]:
    """A scorer of (query, text) pairs by batches. `load` is hashable and gives the model: once for each worker process if
    equal loads are equal after pickling, as frozen dataclasses are, else once for each task. Nulls are empty texts."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(load)
        for queries, texts in batches:
            yield pd.Series(np.asarray(model(queries.fillna(""), texts.fillna("")), np.float64))

    return score.asNondeterministic()  # else the optimizer moves it below the limit on candidates and sorts all rows


def scorer(load: Callable[[], PairModel]) -> Callable[[str], Callable[[Column], Column]]:
    """For SearchParams.scorer: query -> text column -> score column."""
    score = pair_udf(load)
    return lambda query: lambda text: score(F.lit(query), text)


def pair_bins(query: str, text: str) -> tuple[int, int, int]:
    """Bins of 0 to 4: the share of distinct query words in the text, the share of neighbouring query words that are
    neighbours there, and the quarter of the text in which the first query word stands (4: in none)."""
    asked, words = query.lower().split(), text.lower().split()
    own, pairs = set(asked), set(zip(asked, asked[1:]))
    coverage = 4 * len(own.intersection(words)) // max(1, len(own))
    phrases = 4 * len(pairs.intersection(zip(words, words[1:]))) // max(1, len(pairs))
    first = next((i for i, w in enumerate(words) if w in own), None)
    return coverage, phrases, 4 if first is None else 4 * first // len(words)


@dataclass(frozen=True)
class BinnedOdds:
    """The fitted model: one weight for each bin of each feature. Called without arguments it is its own load."""

    weights: tuple[tuple[float, ...], ...] = ((0.0,) * BINS,) * len(FEATURES)

    def __call__(self) -> PairModel:
        return self.score

    def score(self, queries: pd.Series, texts: pd.Series) -> np.ndarray:
        """Probability that the text answers the query."""
        bins = np.array([pair_bins(q, t) for q, t in zip(queries, texts)], np.int64).reshape(-1, len(FEATURES))
        table = np.array(self.weights)
        return 1 / (1 + np.exp(-sum(table[f, bins[:, f]] for f in range(len(FEATURES)))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bins(queries: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([list(pair_bins(q or "", t or "")) for q, t in zip(queries, texts)], dtype=object)


def fit(pairs: DataFrame) -> BinnedOdds:
    """The model of judged pairs (query, text, relevant); every pair counts, those without a judgement do not.

    Counts begin at one, so a bin that no pair has weighs next to nothing, and without any pair all scores are 0.5.
    """
    judged = pairs.filter("relevant IS NOT NULL").select("relevant", F.posexplode(_bins("query", "text")).alias("feature", "bin"))
    seen = {(r["feature"], r["bin"], r["relevant"]): r["count"] for r in judged.groupBy("feature", "bin", "relevant").count().collect()}  # 30 rows at most
    total = {y: sum(seen.get((0, b, y), 0) for b in range(BINS)) for y in (True, False)}
    share = lambda f, b, y: math.log((seen.get((f, b, y), 0) + 1) / (total[y] + BINS))
    return BinnedOdds(tuple(tuple(share(f, b, True) - share(f, b, False) for b in range(BINS)) for f in range(len(FEATURES))))


def cloze_pairs(docs: DataFrame, asking: DataFrame, words: int = QUERY_WORDS) -> DataFrame:
    """Judged pairs from texts alone: some words of a document, taken out of it, ask for the rest, and not for the next text.

    docs: doc_id and text; asking: the doc_ids that ask (long texts: twice `words` at least). Rows without an id take no
    part; of the next id's text, null is empty, and there is no such pair where no row has that id.
    """
    split = docs.select("doc_id", tokenize("text").alias("_w"))
    n, at = F.size("_w"), F.col("_at")
    asked = split.join(asking.select("doc_id").distinct(), "doc_id", "left_semi").filter(n >= 2 * words)
    asked = asked.withColumn("_at", F.pmod("doc_id", n - words + 1).cast("int"))
    query = F.array_join(F.slice("_w", at + 1, words), " ").alias("query")
    rest = F.array_join(F.concat(F.slice("_w", F.lit(1), at), F.slice("_w", at + words + 1, n)), " ")
    own = asked.select(query, rest.alias("text"), F.lit(True).alias("relevant"))
    following = asked.select((F.col("doc_id") + 1).alias("doc_id"), query).join(docs.select("doc_id", "text"), "doc_id")
    return own.union(following.select("query", "text", F.lit(False)))
