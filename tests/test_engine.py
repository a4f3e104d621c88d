import json

import pytest

from notewell import cli
from notewell.engine import NoteEngine
from notewell.operators.filters import QueryFilter, Wanted
from notewell.plans.search import SearchParams

NOTES = {
    "L/2024-01-05-sqlite.md": "---\ntitle: SQLite tips\ntags: [databases, sqlite]\n---\nWhen to use sqlite as an embedded database.",
    "L/2024-02-07-garden.md": "---\ntags: [garden]\nstatus: hidden\n---\nTomatoes and basil grow well in the garden.",
    "Daily/2024-02-09.md": "---\ntags: [daily]\n---\nToday the sqlite database was slow.",
    "L/long.md": "# Long\n" + "Postgres replication notes. " * 300,
}


@pytest.fixture()
def engine(spark, tmp_path):
    for path, text in NOTES.items():
        f = tmp_path / "vault" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return NoteEngine(spark, str(tmp_path / "vault"), str(tmp_path / "index"), "main")


def test_index_search_and_reindex(engine, tmp_path, capsys):
    assert engine.reindex() == {"new": 4}
    assert engine.reindex() == {}
    found = engine.search(SearchParams("sqlite database", mode="bm25", limit=2)).collect()
    assert found[0]["relative_path"] == "L/2024-01-05-sqlite.md" and found[0]["uri"] == "obsidian://vault/main/L/2024-01-05-sqlite"
    both = engine.search(SearchParams("garden tomatoes", mode="hybrid", limit=5)).collect()
    assert "L/2024-02-07-garden.md" not in [r["relative_path"] for r in both]  # hidden
    tagged = SearchParams("sqlite", mode="semantic", min_score=-1, query_filter=QueryFilter(tags=Wanted((), ("daily",))))
    paths = [r["relative_path"] for r in engine.search(tagged).collect()]
    assert paths[0] == "L/2024-01-05-sqlite.md" and "Daily/2024-02-09.md" not in paths
    assert len([p for p in paths if p == "L/long.md"]) == 1
    with pytest.raises(ValueError):
        engine.search(SearchParams(" "))

    (tmp_path / "vault/L/long.md").unlink()
    (tmp_path / "vault/L/new.md").write_text("A new sqlite note")
    assert engine.reindex() == {"new": 1, "deleted": 1}
    assert engine.stats().first()["num_items"] == 4
    entries, months = engine.topic("sqlite database", threshold=0.05)
    assert {r["month"] for r in months.collect()} >= {"2024-01", "2024-02"} and entries.count() >= 2

    base = ["--vault", str(tmp_path / "vault"), "--index", str(tmp_path / "index"), "--name", "main"]
    capsys.readouterr()
    cli.main([*base, "search", "sqlite", "--limit", "2"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(lines) == 2 and "rrf" in lines[0]
    cli.main([*base, "log"])
    assert json.loads(capsys.readouterr().out.splitlines()[0])["searches"] == 1
