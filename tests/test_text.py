import datetime

import pytest
from pyspark.sql import functions as F

from notewell.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("content", ["a " * 300 + "needle" + " b" * 300, "x" * 400 + "needle" + "y" * 400, "needle " + "z" * 500, "lead " * 40 + "needle"])
def test_snippet_shows_the_word(spark, content):
    got = one(spark, tx.snippet("c", "no needle"), c=content)
    shown = got.removeprefix("...").removesuffix("...").strip()
    assert "needle" in shown and shown in content and len(shown) <= 150
    assert got.startswith("...") == (not content.startswith(shown)) and got.endswith("...") == (not content.rstrip().endswith(shown))


@pytest.mark.parametrize("content, want", [("", ""), ("short text", "short text"), ("ends with the needle", "ends with the needle"), ("w" * 200, "w" * 150 + "...")])
def test_snippet_of_short_and_unmatched_texts(spark, content, want):
    assert one(spark, tx.snippet("c", "no needle"), c=content) == want


def test_tokenize_splits_all_white_space(spark):
    assert one(spark, tx.tokenize("c"), c="  Ab\tc D\u001ce  ") == ["ab", "c", "d", "e"]
    assert one(spark, tx.tokenize("c"), c=None) == []


def test_clean_markdown(spark):
    raw = "# Title\n\n**bold** *it* `code` [[note]] [label](http://x)\n"
    assert one(spark, tx.clean_markdown("c"), c=raw) == "Title bold it code note label"


def test_description(spark):
    assert one(spark, tx.description("c"), c="short") == "short"
    assert one(spark, tx.description("c"), c="a" * 99 + "." + "b" * 99) == "a" * 99 + "."
    assert one(spark, tx.description("c"), c="a" * 20 + "." + "b" * 199) == ""
    assert one(spark, tx.description("c"), c="a" * 100 + " " + "b" * 99) == "a" * 100 + "..."
    assert one(spark, tx.description("c"), c="a" * 200) == "a" * 150 + "..."


def test_dates(spark):
    assert one(spark, tx.note_date("p"), p="Daily/2025-11-16-x.md") == datetime.date(2025, 11, 16)
    assert one(spark, tx.note_date("p", F.lit("2024/02/03")), p="2024-13-45.md") == datetime.date(2024, 2, 3)
    assert one(spark, tx.note_date("p"), p="x.md") is None


def test_links_and_paths(spark):
    assert one(spark, tx.deep_link("v", "p"), p="a b/c~*+é.md") == "obsidian://vault/v/a%20b/c~%2A%2B%C3%A9"
    assert one(spark, tx.stem("p"), p="a/b.c.md") == "b.c"
    assert one(spark, tx.parent("p"), p="b.md") == "."


def test_json_list_and_finite(spark):
    assert one(spark, tx.json_list("c"), c='["a","b"]') == ["a", "b"]
    assert one(spark, tx.json_list("c"), c="{}") == [] and one(spark, tx.json_list("c"), c="oops") == []
    for bad in (float("nan"), float("inf"), float("-inf")):
        assert one(spark, tx.finite("v"), v=bad) is None
    assert one(spark, tx.finite("v"), v=1.5) == 1.5


def test_inline_tags(spark):
    assert one(spark, tx.inline_tags("c"), c="#b x #a-1 #b") == ["a-1", "b"]
