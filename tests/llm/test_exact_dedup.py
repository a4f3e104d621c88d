import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from notewell.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"
ROWS = [
    (5, "a  b\tc", "en"),
    (3, "a b c", "de"),
    (3, "a b c", "fr"),
    (9, "a\x0b\x0cb\r\nc", None),
    (None, "a b c", "en"),
    (7, None, "en"),
    (8, "", "en"),
    (2, " \n\t ", "en"),
    (4, " ", "en"),
    (1, "a b c", "en"),
    (None, "only without id", "en"),
    (None, "only without id", "de"),
    (10, "A b c", "en"),
    (11, " a b c", "en"),
    (12, "long \n" * 60_000, "en"),
    (13, "long\t" * 60_000, "en"),
]


def brute(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and how many rows stay per group."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    rows = df.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")), "kept").collect()
    kept = defaultdict(list)
    for r in rows:
        if r["kept"]:
            kept[r[3]].append(r["doc_id"])
    assert set(kept) == {r[3] for r in rows} and all(len(v) == 1 for v in kept.values())
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted((tuple(r)[:4] for r in rows), key=str)


def test_copies_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, DOC).repartition(5)
    assert found(exact_dedup.exact_copies(docs)) == brute(ROWS)


@pytest.mark.parametrize("hashes", [1, 1_000_000])
def test_collisions_are_split_by_bytes(spark, monkeypatch, hashes):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", hashes)
    docs = spark.createDataFrame(ROWS, DOC)
    weak = exact_dedup.exact_copies(docs, digest=lambda t: F.pmod(F.length(t), F.lit(3)))
    assert found(weak) == brute(ROWS)


def test_a_hot_group_and_an_empty_table(spark):
    rows = [(i, "the same\n text" if i % 3 else f"text {i}", "en") for i in range(2000)]
    assert found(exact_dedup.exact_copies(spark.createDataFrame(rows, DOC))) == brute(rows)
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_copies(empty).count() == 0 and exact_dedup.first_copies(empty).count() == 0


def test_first_copies_keep_whole_rows_of_any_columns(spark):
    schema = "doc_id long, text string, key string, _n long, digest array<string>"
    rows = [(3, "x  y", "k", 1, ["a"]), (3, "x y", "j", 2, None), (4, "x\ty", "k", 1, []), (5, "z", None, None, None)]
    rows += [(6, "same row", "k", 1, [])] * 3
    for deal in (rows, rows[::-1]):
        out = [tuple(r) for r in exact_dedup.first_copies(spark.createDataFrame(deal, schema)).collect()]
        assert len(out) == 3 and out.count(rows[-1]) == 1 and rows[3] in out
        ours = [r for r in out if r[0] == 3]
        assert len(ours) == 1 and ours[0] in rows[:2]
        if deal is rows:
            first = ours
    assert ours == first


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_exact_dedup"]).fetchall()
    got = queries.op11_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
