import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from notewell.operators import pair_scoring, ranking
from notewell.plans import search


def _rows(spark, texts):
    rows = [(i, 1 - i / 100, t, f"title {i}", f"p{i}.md", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, similarity double, content string, title string, relative_path string, status string")


_lengths = lambda: lambda queries, texts: texts.str.len() + queries.str.len() * 1000  # noqa: E731, a lambda travels to the workers


def test_bins():
    assert pair_scoring.pair_bins("a b c", "x A b y") == (2, 2, 1)
    assert pair_scoring.pair_bins("a a", "b") == (0, 0, 4)
    assert pair_scoring.pair_bins("", "") == (0, 0, 4)
    assert pair_scoring.pair_bins("a b", "a b") == (4, 4, 0)


def test_fit_counts_every_judged_pair(spark):
    pairs = [("a b", "a b c d", True), ("a b", "c d", False), ("a b", "b x y z", True), ("a", None, False), ("a b", "a b", None), (None, "a", True)]
    model = pair_scoring.fit(spark.createDataFrame(pairs, "query string, text string, relevant boolean"))
    for f in range(3):
        for b in range(5):
            n = {y: sum(pair_scoring.pair_bins(q or "", t or "")[f] == b for q, t, r in pairs if r is y) for y in (True, False)}
            assert model.weights[f][b] == pytest.approx(math.log((n[True] + 1) / 8) - math.log((n[False] + 1) / 7))


def test_no_pairs_score_a_half(spark):
    model = pair_scoring.fit(spark.createDataFrame([], "query string, text string, relevant boolean"))
    assert model.score(pd.Series(["a"]), pd.Series(["a b"])).tolist() == pytest.approx([0.5])
    assert model.score(pd.Series([], dtype=object), pd.Series([], dtype=object)).tolist() == []


def test_cloze_pairs(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (4, None, "x"), (5, "g h i j", "y"), (7, "k l", "y"), (None, "a b c d", "z")], "doc_id long, text string, query string")
    asking = docs.select("doc_id").union(docs.select("doc_id"))
    got = sorted(map(tuple, pair_scoring.cloze_pairs(docs, asking, 2).collect()), key=str)
    assert got == sorted([("d e", "a b c f", True), ("d e", None, False), ("i j", "g h", True)], key=str)


def test_model_improves_the_order(spark):
    pairs = [(f"w{i} w{i + 1}", f"w{i} w{i + 1} rest of it" if good else "other words", good) for i in range(30) for good in (True, False)]
    model = pair_scoring.fit(spark.createDataFrame(pairs, "query string, text string, relevant boolean"))
    rows = _rows(spark, ["nothing here", "green only", "a green house", "house of green"])
    got = ranking.rerank(rows, "similarity", pair_scoring.scorer(model)("green house"), 4).collect()
    assert [r["doc_id"] for r in got][0] == 2 and {r["doc_id"] for r in got[-1:]} == {0}
    assert all(0 < r["cross_encoder"] < 1 for r in got) and got[0]["similarity"] == 0.98 and got[0]["title"] == "title 2"


def test_candidates_top_k_and_missing_texts(spark):
    rows = _rows(spark, ["aaa", "", None, "aaaaaaaaaaaaaaaaaaaa"])
    by_length = pair_scoring.scorer(_lengths)("q")
    got = [(r["doc_id"], r["cross_encoder"]) for r in ranking.rerank(rows, "similarity", by_length, 2, 3).collect()]
    assert got == [(1, 1013.0), (2, 1013.0)]  # title and path stand in for the text; the fourth row is no candidate
    assert ranking.rerank(rows.limit(0), "similarity", by_length, 2).collect() == []


def test_scorer_is_a_parameter_of_a_search(spark):
    rows = _rows(spark, ["aaa", "aaaaaa", "a"])
    params = search.SearchParams("q", mode="semantic", limit=2, rerank=True, time_boost=False, scorer=pair_scoring.scorer(_lengths))
    assert [r["doc_id"] for r in search.run_stages(rows, params).collect()] == [1, 0]


def test_a_process_loads_a_model_once():
    made = []

    class Load:
        def __hash__(self):
            return 1

        def __eq__(self, other):
            return isinstance(other, Load)

        def __call__(self):
            made.append(1)
            return lambda q, t: [0.0] * len(q)

    pair_scoring._loaded.clear()
    assert pair_scoring._model(Load()) is pair_scoring._model(Load()) and made == [1]
    pair_scoring._model(_lengths)
    assert len(pair_scoring._loaded) == 1


def test_only_candidates_reach_the_model(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.rand(1).alias("similarity"), F.lit("t").alias("content"), F.lit("t").alias("title"), F.lit("p").alias("relative_path"))
    plan = ranking.rerank(rows, "similarity", pair_scoring.scorer(_lengths)("q"), 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("limit=5,") < plan.index("ArrowEvalPython") < plan.index("limit=20,")
