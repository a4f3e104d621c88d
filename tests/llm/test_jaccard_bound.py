"""Tables whose only links lie at the bound, or just over or under it."""

import pytest

from notewell.llm import jaccard_join

DOC = "doc_id long, text string"


def pair(tag, shared, own, n_words):
    """Two texts of words found nowhere else: `shared` common shingles, `own` of each alone."""
    common = [f"{tag}c{k}" for k in range(shared + n_words - 1)]
    return [" ".join(common + [f"{tag}{side}{k}" for k in range(own)]) for side in "ab"]


def components_of(spark, texts, n_words, percent):
    rows = spark.createDataFrame(list(enumerate(texts)), DOC)
    out = jaccard_join.near_duplicates(rows, n_words, percent).collect()
    return {r["doc_id"]: r["component_id"] for r in out}


@pytest.mark.parametrize("n_words, percent, shared", [(3, 90, 18), (5, 80, 8)])
def test_links_at_the_bound(spark, n_words, percent, shared):
    # shared * k of (shared + 1) * k shingles each: exactly the bound. Sizes from 9 or 19 to 2,000.
    texts, sizes = [], [1, 1, 2, 3, 5, 5, 5, 8, 13, 21, 34, 55, 105] * 2 + [10, 15, 20, 25]
    for i, k in enumerate(sizes):
        texts += pair(f"p{i}x", shared * k, k, n_words)
    got = components_of(spark, texts, n_words, percent)
    assert got == {d: d - d % 2 for d in got} and len(got) == 2 * len(sizes)


@pytest.mark.parametrize("n_words, percent, shared", [(3, 90, 18), (5, 80, 8)])
def test_one_link_at_the_bound_beside_near_and_far_pairs(spark, n_words, percent, shared):
    texts = pair("at", 5 * shared, 5, n_words) + pair("near", 200, 1, n_words)
    texts += pair("over", 10 * shared + 1, 10, n_words) + pair("under", 10 * shared - 1, 10, n_words)
    got = components_of(spark, texts, n_words, percent)
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}
    assert components_of(spark, texts[:2], n_words, percent) == {0: 0, 1: 0}
