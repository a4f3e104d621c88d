import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from notewell.oracles import ORACLE_SQL
from notewell.plans import registry, search
from notewell.queries import QUERIES
from notewell.sources import index_store, notes, query_log

SF = "/root/testdata/sf0.001"


def test_gated_pipeline(spark):
    rows = spark.createDataFrame(
        [(1, 0.9, "active"), (2, 0.8, "hidden"), (3, 0.4, None), (4, 0.35, "active"), (5, 0.1, None)], "doc_id int, similarity double, status string"
    ).withColumn("rrf", F.col("similarity"))
    semantic = search.SearchParams("q", mode="semantic", limit=2, time_boost=False)
    assert [r["doc_id"] for r in search.run_stages(rows, semantic).collect()] == [1, 3]
    hybrid = search.SearchParams("q", mode="hybrid", limit=9, time_boost=False)
    assert [r["doc_id"] for r in search.run_stages(rows, hybrid).collect()] == [1, 3, 4, 5]
    counts = [tuple(r) for r in search.stage_counts(rows, semantic).orderBy("position").collect()]
    assert counts == [("score", 0, 5, 4), ("status", 1, 4, 3), ("limit", 2, 3, 2)]


def test_top_k_needs_no_shuffle(spark):
    plan = QUERIES["semantic_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_vault(spark, tmp_path):
    for path, text in {
        "a/note.md": "---\ntitle: T\ntags: [x, x, y]\ndescription: D\n---\n# Head\nbody [[link]]\n",
        "a/plain.txt": "just text",
        ".hidden/n.md": "no",
        "Utilities/n.md": "no",
        "a/blank.md": "  \n",
        "a/bad.md": "---\n: [\n---\nstill here",
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {r["relative_path"]: r for r in notes.read_notes(notes.read_vault(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["a/bad.md", "a/note.md", "a/plain.txt"]
    assert got["a/note.md"]["title"] == "T" and got["a/note.md"]["tags"] == ["x", "y"]
    assert got["a/note.md"]["content"] == "D. Head body link" and got["a/plain.txt"]["title"] == "plain"


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "relative_path string, n int")
    index_store.guard(spark, path, "v1")
    index_store.save(rows, path, "v1", "1")
    index_store.save(rows.filter("n = 1"), path, "v1", "2")
    assert index_store.load(spark, path).count() == 2 and index_store.manifest(spark, path)["num_files"] == 2
    index_store.guard(spark, path, "v1")
    index_store.guard(spark, path, "v2", force=True)
    with pytest.raises(index_store.WrongOwner):
        index_store.guard(spark, path, "v2")


def test_log_append(spark, tmp_path):
    rows = spark.createDataFrame([("q", [("a", 0.82), ("b", 0.71)]), ("r", [("a", 0.5)]), ("s", [])], "query string, results array<struct<path:string,score:double>>")
    query_log.append(rows, str(tmp_path / "log"))
    query_log.append(rows.limit(1), str(tmp_path / "log"))
    got = {r["query"]: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got["q"]["top_score"] == 0.82 and abs(got["q"]["score_p50"] - 0.765) < 1e-9
    assert got["r"]["score_p50"] is None and got["s"]["top_score"] is None and json.loads(got["q"]["results_json"])[0]["path"] == "a"


def test_registry(tmp_path):
    vaults = [registry.Vault("Main", str(tmp_path)), registry.Vault("Other", "/o", True)]
    assert registry.find_vault(vaults).name == "Other" and registry.find_vault(vaults, "main").name == "Main"
    assert registry.find_vault(vaults, str(tmp_path)).name == "Main"
    with pytest.raises(LookupError):
        registry.find_vault(vaults, "none")
    assert registry.compatible("all-MiniLM-L6-v2", "all-MiniLM-L12-v2") and not registry.compatible("all-MiniLM-L6-v2", "all-mpnet-base-v2")
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"vault_path": str(tmp_path), "search": {"default_limit": 7}}))
    assert registry.load_config(str(f)).default_limit == 7
    with pytest.raises(FileNotFoundError):
        registry.load_config(places=[str(tmp_path / "none")])
    released = []
    cache = registry.ResidentIndexes(3, lambda k: k, released.append)
    for k in ("v1", "v2", "v3", "v1", "v4"):
        cache.get(k)
    assert released == ["v2"] and list(cache.held) == ["v3", "v1", "v4"]


def test_stream_decides_like_the_batch(spark, tmp_path):
    from notewell.operators.rate_limit import admitted
    from notewell.streaming.stateful import admitted_stream

    rows = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts")
    )
    cut = rows.selectExpr("percentile(unix_micros(ts), 0.5)").first()[0]
    early = F.unix_micros("ts") < cut
    source = str(tmp_path / "in")
    rows.filter(early).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    start = lambda: (
        admitted_stream(stream, 1, 86_400).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    start()
    rows.filter(~early).coalesce(1).write.mode("append").parquet(source)
    start()
    got = {r["request_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["request_id"]: r["allowed"] for r in admitted(rows, 1, 86_400).collect()}


def _plain(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents events embeddings benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(QUERIES)
