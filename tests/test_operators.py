import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notewell.operators import chunking, expansion, filters, fusion, lexical, log_stats, maintenance, ranking, rate_limit, topics
from notewell.operators.filters import QueryFilter, Wanted


def ids(df, key="doc_id"):
    return sorted(r[key] for r in df.select(key).collect())


def windows(n, size, overlap):
    """Chunk bounds by the loop: a window that would leave under half a size behind takes the rest."""
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        left = n - (start + size - overlap)
        if end < n and left < size // 2:
            end = n
        out.append((start, end))
        if end == n:
            break
        start += size - overlap
    return out


def test_chunks_match_the_loop(spark):
    for size, overlap, lengths in ((2000, 400, [3999, 4000, 5000, 3900, 12_345]), (50, 10, range(1, 300, 7))):
        rules = chunking.ChunkRules(size, overlap, threshold=size)
        rows = spark.createDataFrame([(n, "x" * n) for n in lengths], "doc_id int, content string")
        got = {}
        for r in chunking.chunk(rows, rules).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_start"], r["chunk_end"]))
            assert len(r["content"]) == r["chunk_end"] - r["chunk_start"]
        assert {n: sorted(v) for n, v in got.items()} == {n: windows(n, size, overlap) for n in lengths}


def test_chunk_edges(spark):
    rows = spark.createDataFrame([(1, ""), (2, " \n "), (3, "a" * 3999), (4, "a" * 4000)], "doc_id int, content string")
    assert [(r["doc_id"], r["chunk_total"]) for r in chunking.chunk(rows).orderBy("doc_id", "chunk_index").collect()] == [(3, 1), (4, 2), (4, 2)]
    with pytest.raises(ValueError):
        chunking.ChunkRules(2000, 2500)
    empty = chunking.statistics(chunking.chunk(rows.limit(0))).first()
    assert empty["num_chunks"] == 0 and empty["avg_chunk_size"] == 0


CORPUS = [(1, "one", ["db"], "the cat sat"), (2, "two", [], "the dog sat on the cat"), (3, "three", ["sqlite"], "fish"), (4, "four", None, "")]


def plain_bm25(texts, query):
    docs = {k: t.lower().split() for k, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for k, words in docs.items():
        s = sum(idf.get(q, 0) * words.count(q) * 2.5 / (words.count(q) + 1.5 * (0.25 + 0.75 * len(words) / avg)) for q in query.lower().split())
        if any(q in words for q in query.lower().split()):
            out[k] = s
    return out


def test_bm25_is_the_formula(spark):
    rows = spark.createDataFrame(CORPUS, "doc_id int, title string, tags array<string>, content string")
    texts = {k: " ".join([t, *(g or []), *(g or []), c]) for k, t, g, c in CORPUS}
    index = lexical.build_index(rows, lexical.index_text())
    for query in ("cat", "the the dog", "nothing", "sqlite fish"):
        got = {r["doc_id"]: r["bm25"] for r in lexical.scores(index, query).collect()}
        want = plain_bm25(texts, query)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(CORPUS, "doc_id int, title string, tags array<string>, content string")
    index = lexical.build_index(rows, lexical.index_text())
    index.save(str(tmp_path / "i"))
    again = lexical.LexicalIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, lexical.scores(again, "cat fish").collect())) == sorted(map(tuple, lexical.scores(index, "cat fish").collect()))


def test_tag_boost(spark):
    rows = spark.createDataFrame([(1, ["SQLite", "db"], 1.0), (2, ["sqlite-3"], 1.0), (3, None, 1.0)], "doc_id int, tags array<string>, bm25 double")
    got = {r["doc_id"]: (r["bm25"], r["tags_matched"]) for r in lexical.with_tag_boost(rows, "SQLite notes").collect()}
    assert got == {1: (5.0, ["sqlite"]), 2: (5.0, ["sqlite-3"]), 3: (1.0, [])}
    assert all(r["bm25"] == 1.0 for r in lexical.with_tag_boost(rows, "sqlite", boost=1.0).collect())


def test_rrf(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "doc_id string, s double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0), (None, 8.0)], "doc_id string, s double")
    got = {r["doc_id"]: r["rrf"] for r in fusion.rrf([(a, "s"), (b, "s")]).collect()}
    want = {"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 63}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hybrid_boosts(spark):
    rows = spark.createDataFrame(
        [(1, 0.03, 4.0, ["t"], 1, 1), (2, 0.02, 2.0, [], 2, None), (3, 0.01, 1.0, [], 3, 5), (4, 0.015, None, None, None, 2)],
        "doc_id int, rrf double, bm25 double, tags_matched array<string>, bm25_rank int, similarity_rank int",
    )
    got = {r["doc_id"]: (round(r["rrf"], 6), r["tag_boosted"]) for r in fusion.boost_hybrid(rows).collect()}
    assert got == {1: (0.06, True), 2: (round(0.03 * 0.95 * 0.5, 6), False), 3: (0.01, False), 4: (0.015, False)}


def test_best_per_file(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.5)], "relative_path string, chunk_index int, s double")
    got = {r["relative_path"]: (r["best_chunk_index"], r["matched_chunks"]) for r in fusion.best_per_file(rows, "s").collect()}
    assert got == {"a": (1, 2), "b": (0, 1)}
    assert fusion.some_per_file(rows, "s", 1).count() == 2


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, 0.5, "active", ["n"], ["#Db"], {"k": "V"}, "/v/a/x.md"), (2, 0.2, "inactive", None, None, None, "/v/b/y.md"), (3, None, None, ["m"], ["daily"], {"k": "w"}, "/v/a/z.md")],
        "doc_id int, similarity double, status string, types array<string>, tags array<string>, frontmatter map<string,string>, relative_path string",
    )
    assert ids(filters.min_score(rows, 0.3)) == [1]
    assert ids(filters.visible(rows)) == [1, 3]
    assert ids(rows.filter(filters.type_is(Wanted(("n",))))) == [1]
    assert ids(rows.filter(filters.tag_is(Wanted((), ("##DAILY",))))) == [1, 2]
    assert ids(rows.filter(filters.property_is(Wanted((("k", "v"),))))) == [1]
    assert ids(rows.filter(filters.property_is(Wanted((("", "v"),))))) == []
    both = QueryFilter(paths=Wanted(("/a/",)), files=Wanted((), ("z",)))
    assert ids(filters.apply_filter(rows, both)) == [1]
    assert filters.allowed_files(rows) is None and ids(filters.allowed_files(rows, files=("y",))) == [2]


def test_time_boost(spark):
    now = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(d, 1.0, now - timedelta(days=d)) for d in (0, 90, 180)] + [(-1, 1.0, None)], "doc_id int, s double, modified timestamp")
    got = {r["doc_id"]: round(r["s"], 9) for r in ranking.time_boost(rows, "2025-01-01 00:00:00", "s").collect()}
    assert got == {0: 1.2, 90: 1.1, 180: 1.05, -1: 1.0}


def test_rerank(spark):
    rows = spark.createDataFrame(
        [(1, "unrelated", "cooking with rice", "a.md", 0.8), (2, "relevant", "python async programming", "b.md", 0.7), (3, "async python", "", "", 0.6)],
        "doc_id int, title string, content string, relative_path string, s double",
    )
    got = ranking.rerank(rows, "s", ranking.lexical_overlap("python async"), 3).collect()
    assert [r["doc_id"] for r in got] == [3, 2, 1] and got[0]["title"] == "async python"  # a blank text: title and path
    assert ranking.rerank(rows, "s", ranking.lexical_overlap("x"), 1, 2).count() == 1


def test_expansion(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["sqlite index speed", "sqlite index size", "sqlite table", "index", "sqlite"])], "doc_id int, content string")
    assert expansion.expand("a longer query", rows) == "a longer query"
    assert expansion.expand("db", rows.limit(3)) == "db"
    out = expansion.expand("db", rows)
    assert out.startswith("db ") and {"sqlite", "index"} <= set(out.split())


def test_months(spark):
    days = ["2023-11-02", "2023-11-20", "2024-02-05"]
    rows = spark.createDataFrame([(i, d, 0.4 + 0.2 * i, ["x"]) for i, d in enumerate(days)], "doc_id int, date string, similarity double, tags array<string>").withColumn("date", F.to_date("date"))
    found = topics.entries(rows)
    months = topics.monthly(found)
    assert {r["month"]: r["activity"] for r in months.collect()} == {"2023-11": 2, "2024-02": 1}
    assert [r["month"] for r in topics.dormant(months).orderBy("month").collect()] == ["2023-12", "2024-01"]
    assert [r["month"] for r in topics.peaks(months).collect()] == ["2024-02", "2023-11"]
    assert topics.bars(months).count() == 0


def test_merge_replaces_all_chunks_of_a_path(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    tracked = spark.createDataFrame([("a", t(0)), ("b", t(0)), ("c", t(0))], "relative_path string, modified timestamp")
    current = spark.createDataFrame([("a", t(0)), ("b", t(5)), ("d", t(0))], "relative_path string, modified timestamp")
    changed = maintenance.changes(current, tracked)
    assert {r["relative_path"]: r["change_type"] for r in changed.collect()} == {"b": "modified", "c": "deleted", "d": "new"}
    old = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("b", 2), ("c", 0)], "relative_path string, chunk int")
    fresh = spark.createDataFrame([("a", 9), ("b", 7), ("d", 8)], "relative_path string, chunk int")
    assert sorted(map(tuple, maintenance.merge(old, changed, fresh).collect())) == [("a", 0), ("b", 7), ("d", 8)]


def test_log(spark):
    rows = spark.createDataFrame([(1, None, 100.0, 50.0, None), (2, "hybrid", 201.0, 51.0, None), (3, "hybrid", 900.0, 1.0, "bad")], "id int, mode string, total_ms double, retrieval_ms double, error string")
    assert {r["mode"]: r["searches"] for r in log_stats.by_mode(rows).collect()} == {"unknown": 1, "hybrid": 1}
    assert tuple(log_stats.timing(rows).first()) == (50, 150)  # 50.5 and 150.5, half to even
    assert tuple(log_stats.timing(rows.limit(0)).first()) == (0, 0)
    assert [r["id"] for r in log_stats.recent(rows, 2).collect()] == [3, 2]


def test_rate_limit_ignores_rejected_requests(spark):
    random.seed(1)
    start = datetime(2024, 1, 1)
    rows = [(i, random.choice("ab"), "s", start + timedelta(seconds=random.randrange(20_000))) for i in range(300)]
    requests = spark.createDataFrame(rows, "request_id int, client string, endpoint string, ts timestamp")
    held, want = {}, {}
    for i, c, _, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        held[c] = [t for t in held.get(c, []) if (ts - t).total_seconds() < 3600]
        want[i] = len(held[c]) < 5
        if want[i]:
            held[c].append(ts)
    got = {r["request_id"]: r["allowed"] for r in rate_limit.admitted(requests, 5).collect()}
    assert got == want
    plain = {r["request_id"]: r["earlier"] < 5 for r in rate_limit.window_counts(requests).collect()}
    assert all(got[i] for i, ok in plain.items() if ok) and sum(got.values()) > sum(plain.values())
