import pytest

from notewell.streaming import log_sink

SCHEMA = "id string, results array<struct<path:string,score:double>>"


def _searches(spark, *ids):
    return spark.createDataFrame([(i, [("a", 1.0), ("b", 0.5)]) for i in ids], SCHEMA)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    write = log_sink.batch_writer(path, "s")
    write(_searches(spark, "x", "y"), 0)
    write(_searches(spark, "z"), 1)
    write(_searches(spark, "x", "y"), 0)
    rows = log_sink.read_log(spark, path)
    assert sorted((r["id"], r["batch"], r["stream"]) for r in rows.collect()) == [("x", 0, "s"), ("y", 0, "s"), ("z", 1, "s")]
    assert {(r["top_score"], r["score_p50"], r["result_count"]) for r in rows.collect()} == {(1.0, 0.75, 2)}


def test_unfinished_batch_is_not_read_and_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    write = log_sink.batch_writer(path, "s")
    write(_searches(spark, "x"), 0)
    write(_searches(spark, "half"), 1)
    (tmp_path / "log/stream=s/batch=1/_SUCCESS").unlink()
    assert [r["id"] for r in log_sink.read_log(spark, path).collect()] == ["x"]
    write(_searches(spark, "y", "z"), 1)
    assert sorted(r["id"] for r in log_sink.read_log(spark, path).collect()) == ["x", "y", "z"]


def test_streams_beside_each_other_and_restarts(spark, tmp_path):
    path, source = f"file://{tmp_path}/log", f"{tmp_path}/in"
    _searches(spark, "a").write.parquet(source)
    run = lambda name: log_sink.log_stream(spark.readStream.schema(SCHEMA).parquet(source), path, name, f"{tmp_path}/at-{name}").awaitTermination()
    run("one")
    _searches(spark, "b").write.mode("append").parquet(source)
    run("one")
    run("one")
    run("two")
    got = sorted((r["stream"], r["id"]) for r in log_sink.read_log(spark, path).collect())
    assert got == [("one", "a"), ("one", "b"), ("two", "a"), ("two", "b")]


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(FileNotFoundError):
        log_sink.read_log(spark, path)
    log_sink.batch_writer(path, "s")(_searches(spark, "x").limit(0), 0)
    assert log_sink.read_log(spark, path).count() == 0
