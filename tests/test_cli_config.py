import json

import pytest

from notewell import cli
from notewell.plans import registry


@pytest.fixture
def config(tmp_path):
    for name in ("one", "two", "three"):
        (tmp_path / name).mkdir()
    (tmp_path / "one/a.md").write_text("# Alpha\ngreen house by the river")
    (tmp_path / "one/b.md").write_text("# Beta\nred car in the street")
    raw = {"vault_path": str(tmp_path / "one"), "index_path": str(tmp_path / "idx"), "search": {"default_limit": 1, "max_limit": 2},
           "vaults": [{"name": "One", "path": str(tmp_path / "one"), "is_default": True}, {"name": "Two", "path": str(tmp_path / "two")}]}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    return tmp_path


def test_storage_dir(config):
    found = registry.load_config(str(config / "c.json"))
    assert registry.storage_dir(found, str(config / "one")) == str(config / "idx")
    assert registry.storage_dir(found, str(config / "one/../one")) == str(config / "idx")
    assert registry.storage_dir(found, str(config / "two")) == str(config / "two/.notewell")
    assert registry.storage_dir(None, str(config / "one")) == str(config / "one/.notewell")


def test_limits(config):
    found = registry.load_config(str(config / "c.json"))
    assert [registry.bounded_limit(found, n) for n in (None, 1, 2, 50)] == [1, 1, 2, 2]
    assert [registry.bounded_limit(None, n) for n in (None, 500)] == [10, 500]


def test_chosen_vault(config):
    found = registry.load_config(str(config / "c.json"))
    pick = lambda *more: cli.chosen_vault(cli.parser().parse_args([*more, "stats"]), found).name
    assert [pick(), pick("--vault", "two"), pick("--vault", str(config / "one")), pick("--vault", str(config / "three"))] == ["One", "Two", "One", "three"]
    with pytest.raises(LookupError):
        pick("--vault", "nowhere")


def test_listings(config, capsys, monkeypatch):
    cli.main(["--config", str(config / "c.json"), "vaults"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["name"], r["is_default"], r["index_path"]) for r in rows] == [("One", True, str(config / "idx")), ("Two", False, str(config / "two/.notewell"))]
    monkeypatch.setenv("NOTEWELL_CONFIG", str(config / "c.json"))
    cli.main(["config"])
    assert json.loads(capsys.readouterr().out)["max_limit"] == 2
    monkeypatch.delenv("NOTEWELL_CONFIG")
    with pytest.raises(FileNotFoundError):
        cli.main(["vaults"])


def test_search_of_a_configured_vault(spark, config, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    at = ["--config", str(config / "c.json")]
    cli.main([*at, "index"])
    assert json.loads(capsys.readouterr().out) == {"new": 2} and (config / "idx").is_dir()
    cli.main([*at, "search", "green house", "--no-log"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["relative_path"] for r in rows] == ["a.md"] and "One" in rows[0]["uri"]
    assert rows[0]["scores"]["cross_encoder"] > 0
    cli.main([*at, "search", "green house", "--limit", "9", "--no-rerank", "--no-log"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 2 and rows[0]["scores"]["cross_encoder"] is None
