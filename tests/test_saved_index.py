"""Indexes on disk: versions, postings in blocks, coded vectors, and the engine over them."""

import random

import pytest
from pyspark.sql import functions as F

from notewell import queries
from notewell.engine import NoteEngine
from notewell.operators import block_postings, lexical, maintenance, vector_codes
from notewell.operators.filters import QueryFilter, Wanted
from notewell.plans.search import SearchParams, semantic_topk
from notewell.sources.files import Folder
from notewell.sources.index_store import WrongOwner
from notewell.sources.snapshots import Conflict, SnapshotStore

ROWS = "relative_path string, modified timestamp, n int"


def rows_of(df):
    return sorted((r["relative_path"], r["n"]) for r in df.collect())


def table(spark, pairs):
    return spark.createDataFrame([(p, None, n) for p, n in pairs], ROWS)


def changed(spark, **kinds):
    return spark.createDataFrame([(p.replace("_", "/") + ".md", k) for p, k in kinds.items()], "relative_path string, change_type string")


# Versions ------------------------------------------------------------------------------------------------------------


def test_a_merge_writes_the_buckets_of_changed_paths(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "i"), "main", buckets=16)
    first = store.replace(table(spark, [(f"d/{k}.md", 0) for k in range(200)]))
    before = store.rows()
    size = store.stats()["bytes"]
    fresh = table(spark, [("d/7.md", 1), ("d/new.md", 1), ("d/9.md", 1)])
    change = changed(spark, d_7="modified", d_new="new", d_8="deleted")
    second = store.merge(change, fresh)
    want = sorted([(f"d/{k}.md", 0) for k in range(200) if k not in (7, 8)] + [("d/7.md", 1), ("d/new.md", 1)])
    assert rows_of(store.rows()) == want
    # A reader that has begun sees the old version, and folders of other buckets are shared.
    assert rows_of(before) == sorted((f"d/{k}.md", 0) for k in range(200))
    assert rows_of(store.rows(first)) == rows_of(before)
    written = second.folders - first.folders
    assert 1 <= len(written) <= 3 and sum(map(store.folder.bytes, written)) < size / 2
    # The same merge again gives the same rows.
    store.merge(change, fresh)
    assert rows_of(store.rows()) == want


def test_a_commit_that_breaks_off_or_loses_is_not_seen(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "i"), "main", buckets=4)
    base = store.replace(table(spark, [("a.md", 1)]))

    def broken(rows, path):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.merge(changed(spark, b="new"), table(spark, [("b.md", 1)]), {"lexical": broken})
    assert rows_of(store.rows()) == [("a.md", 1)] and store.version() == base
    store.merge(changed(spark, c="new"), table(spark, [("c.md", 1)]))
    with pytest.raises(Conflict):  # a writer that started from the first version
        store.commit(base, base.rows, store.rows(base).schema, {}, {}, 4)
    gone = store.vacuum(keep=1)
    assert gone and rows_of(store.rows()) == [("a.md", 1), ("c.md", 1)] and len(store.numbers()) == 1
    store.folder.create("manifests/v00000099.json", {})
    (tmp_path / "i/manifests/v00000099.json").write_text("{ cut off")
    assert rows_of(store.rows()) == [("a.md", 1), ("c.md", 1)]  # a manifest that cannot be read is passed over


def test_backup_restore_clear_and_owner(spark, tmp_path):
    path = str(tmp_path / "i")
    store = SnapshotStore(spark, path, "main", buckets=4)
    assert not store.exists() and store.stats() == {"exists": False}
    with pytest.raises(FileNotFoundError):
        store.rows()
    store.guard()
    store.replace(table(spark, [("a.md", 1), ("b.md", 1)]), {"side": lambda rows, to: rows.write.parquet(to)}, {"model": "m"})
    store.backup("monday")
    store.merge(changed(spark, a="deleted"), table(spark, []))
    assert rows_of(store.rows()) == [("b.md", 1)] and store.stats()["model"] == "m"
    with pytest.raises(FileNotFoundError):
        store.table("side")
    store.restore("monday")
    assert rows_of(store.rows()) == [("a.md", 1), ("b.md", 1)] and spark.read.parquet(store.table("side")).count() == 2
    store.vacuum(keep=1)
    assert rows_of(store.rows()) == [("a.md", 1), ("b.md", 1)]
    other = SnapshotStore(spark, path, "other")
    other.guard(force=True)
    with pytest.raises(WrongOwner):
        other.guard()
    store.clear()
    assert not store.exists()
    other.guard()
    store.restore("monday")
    assert rows_of(store.rows()) == [("a.md", 1), ("b.md", 1)]
    empty = SnapshotStore(spark, str(tmp_path / "e"), "main")
    empty.replace(table(spark, []))
    assert empty.rows().count() == 0


# Postings in blocks --------------------------------------------------------------------------------------------------


def docs_of(spark, seed=0, n=600):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(20_000)]
    rows = [(i, f"t{i}", rng.sample(["red", "blue", "w1", "w2"], rng.randrange(3)), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, title string, tags array<string>, content string")


def best(df):
    return [(r["doc_id"], round(r["bm25"], 7)) for r in df.collect()]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    docs, path = docs_of(spark), str(tmp_path_factory.mktemp("blocks"))
    block_postings.save(docs, lexical.index_text(), path, shelves=8, cell_docs=20)
    return docs, block_postings.SavedIndex.load(spark, path), lexical.build_index(docs, lexical.index_text())


@pytest.mark.parametrize("query", ["w1 w2", "w5 w9 w300", "red w3", "w1 w1 w40", "none", "", "w17"])
@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_saved_search_equals_the_plain_one(saved, query, limit):
    docs, index, plain = saved
    assert best(index.search(docs, query, limit)) == best(lexical.search(plain, docs, query, limit))
    allowed = docs.filter("doc_id % 5 = 2").select("doc_id")
    assert best(index.search(docs, query, limit, allowed=allowed)) == best(lexical.search(plain, docs, query, limit, allowed=allowed))


def test_a_query_opens_few_folders_and_cells(saved):
    docs, index, _ = saved
    weights = index.weights("w17 w300")
    plan = index.scores(weights)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan and "PushedFilters: [In(term" in plan
    read = index.scores(weights).inputFiles()
    assert len({f.rpartition("/")[0] for f in index.spark.read.parquet(f"{index.path}/blocks").inputFiles()}) == 8
    bounds = index.bounds(weights)
    full = index.scores(weights).withColumn("cell", block_postings.cell_of("doc_id", index.cells))
    over = full.join(bounds, "cell").filter(F.col("bm25") > F.col("bound") + 1e-9).count()
    assert over == 0 and read
    assert index.candidates("w17 w300", 1).count() < index.scores(weights).count()


def test_saved_index_of_odd_documents(spark, tmp_path):
    rows = [(1, "", [], ""), (2, None, None, None), (3, "same", ["x"], "one one"), (4, "same", ["x"], "one one"), (None, "no", [], "id one")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, tags array<string>, content string")
    block_postings.save(docs, lexical.index_text(), str(tmp_path / "a"))
    index = block_postings.SavedIndex.load(spark, str(tmp_path / "a"))
    plain = lexical.build_index(docs, lexical.index_text())
    # Words in most of the documents have a negative weight here; all are scored then.
    assert best(index.search(docs, "one same", 5, min_score=-9)) == best(lexical.search(plain, docs, "one same", 5, min_score=-9))
    block_postings.save(docs.limit(0), lexical.index_text(), str(tmp_path / "b"))
    assert block_postings.SavedIndex.load(spark, str(tmp_path / "b")).search(docs, "one").count() == 0


# Coded vectors -------------------------------------------------------------------------------------------------------


def test_coded_search_equals_the_exact_one(spark, tmp_path):
    rng = random.Random(5)
    near = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, [x + rng.gauss(0, 1e-4) for x in near]) for i in range(50)] + [(2000 + i, near) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1e-200] + [0.0] * 15), (3004, [x * 1e6 for x in near])]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    vector_codes.save(docs, str(tmp_path / "v"))
    query = spark.createDataFrame([(near,)], "q array<double>")
    sound = docs.filter("doc_id NOT IN (3001, 3002, 3003)")
    for k in (1, 20, 70, 1000):
        got = [(r["doc_id"], r["similarity"]) for r in vector_codes.search(spark, str(tmp_path / "v"), query, k).collect()]
        got = [g for g in got if g[0] != 3003]
        want = [(r["doc_id"], r["similarity"]) for r in semantic_topk(sound, query, k).collect()]
        assert got == want
    only = docs.filter("doc_id < 100").select("doc_id")
    got = [r["doc_id"] for r in vector_codes.search(spark, str(tmp_path / "v"), query, 5, only).collect()]
    assert got == [r["doc_id"] for r in semantic_topk(sound, query, 5, only).collect()]
    codes = spark.read.parquet(str(tmp_path / "v/codes"))
    exact = sound.crossJoin(query).select("doc_id", vector_codes.cosine("embedding", "q").alias("s"))
    assert vector_codes.bounded(codes, query).join(exact, "doc_id").filter("s < low OR s > high").count() == 0
    few = vector_codes.bounded(codes, query).filter("high > 0.99").count()
    assert few < 100  # the bounds are near enough to leave most vectors unread


# The engine ----------------------------------------------------------------------------------------------------------


def test_engine_filters_before_the_search(spark, tmp_path):
    vault = tmp_path / "vault"
    for k in range(30):  # far better than the notes that are asked for, and more than twice the limit
        f = vault / f"Loud/{k}.md"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"---\nkind: loud\n---\nsqlite database sqlite database number {k}")
    (vault / "Quiet").mkdir()
    (vault / "Quiet/a.md").write_text("---\ntitle: A\nkind: Quiet\ndescription: tapestry weaving\n---\nA long note that names sqlite once among many other words about a loom")
    (vault / "Quiet/b.md").write_text("---\ntags: [loom]\n---\nAnother one with a database in it and many many other words beside")
    engine = NoteEngine(spark, str(vault), str(tmp_path / "index"), "main")
    assert engine.reindex() == {"new": 32}
    for mode in ("bm25", "semantic", "hybrid"):
        wanted = QueryFilter(paths=Wanted(("Quiet/",)))
        found = engine.search(SearchParams("sqlite database", mode, 3, -1.0, query_filter=wanted)).collect()
        assert {r["relative_path"] for r in found} == {"Quiet/a.md", "Quiet/b.md"}
    props = QueryFilter(paths=Wanted(("Quiet/",)), properties=Wanted((("kind", "quiet"),)))
    answer = engine.answer(SearchParams("sqlite database", "semantic", 3, -1.0, query_filter=props))
    assert [r["relative_path"] for r in answer.rows] == ["Quiet/a.md"]
    assert [s for s in answer.stages if s[0] == "query_filter"] == [("query_filter", 2, 2, 1)] and answer.total_ms > 0
    # The description counts twice in the keyword index, and a changed note is one bucket's work.
    assert engine.search(SearchParams("tapestry", "bm25", 3)).first()["relative_path"] == "Quiet/a.md"
    before = engine.store.version()
    (vault / "Quiet/c.md").write_text("a new sqlite note")
    old = engine.rows()
    assert engine.reindex() == {"new": 1} and engine.reindex() == {}
    after = engine.store.version()
    assert len({*after.rows.values()} - {*before.rows.values()}) == 1 and old.count() == 32 and engine.rows().count() == 33
    assert engine.search(SearchParams("sqlite", "bm25", 40)).count() == 32


def test_changes_of_a_vault_follow_through(spark):
    now = table(spark, [("a.md", 1)])
    assert maintenance.changes(now, now.select("relative_path", "modified")).count() == 0


def test_words_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "ü A a")], "doc_id long, content string")
    counted = lexical.counted_words(docs, F.col("content"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["dl"], [tuple(w) for w in r["words"]]) for r in counted.collect()}
    assert got == {1: (3, [("a", 1), ("b", 2)]), 2: (0, []), 3: (0, []), 4: (3, [("a", 2), ("ü", 1)])}
    postings = lexical.build_index(docs, F.col("content")).postings
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()


def test_a_part_of_the_saved_index_is_written_when_it_is_asked_for(spark, tmp_path):
    notes = spark.createDataFrame([(k, f"text {k}", "en", "src1", 6) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    notes.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(20)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    path = queries.saved_index(spark, str(tmp_path), ("vectors",))
    assert Folder(spark, path).names() == ["vectors"]
    assert queries.saved_index(spark, str(tmp_path)) == path and Folder(spark, path).names() == ["lexical", "vectors"]


def test_a_merge_does_not_shuffle_rows_to_the_changed_paths(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "i"), "main", buckets=4)
    store.replace(table(spark, [(f"d/{k}.md", 0) for k in range(100)]))
    plans, write = [], store._write
    monkeypatch.setattr(store, "_write", lambda rows, n: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, n))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with changed paths of many MB
    try:
        store.merge(changed(spark, d_7="modified", d_8="deleted"), table(spark, [("d/7.md", 1)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plans[0] and plans[0].count("BroadcastHashJoin") == 2
    assert rows_of(store.rows()) == sorted([(f"d/{k}.md", 0) for k in range(100) if k not in (7, 8)] + [("d/7.md", 1)])
