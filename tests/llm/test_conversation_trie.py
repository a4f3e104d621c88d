import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.llm import conversation_trie as trie
from notewell.llm import queries
from notewell.llm.running import Rolling, carried, running

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_saved + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    out = []
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_turns(rng, convs, words=3, longest=9):
    out = []
    for c in convs:
        for turn in range(rng.randrange(1, longest)):
            out.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["", "a", "bb", "ccc é"][:words])))
    return out


ODD = [
    (0, None, None, None),
    (0, 1, "user", "hi"),
    (0, 1, "user", "hi"),
    (0, 1, "bot", "tie"),
    (1, 5, None, ""),
    (7, 2, "user", "x" * 100_000),
    (None, 1, "user", "no id"),
    (-3, 1, "user", "negative"),
    (-103, 1, "user", "negative"),
    (-100, 1, "user", "negative"),
    (250, 1, "user", "family without head"),
    (1 << 40, 3, "bot", "far"),
]


def test_odd_rows(spark):
    rows = ODD + random_turns(random.Random(1), [*range(0, 12), 100, 101, 102, 205])
    turns = spark.createDataFrame(rows, TURNS).withColumn("f0", F.lit("clash")).withColumn("depth", F.lit(1))
    assert rows_of(trie.conversation_trie(turns)) == brute(rows)
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_a_long_conversation_and_common_turns(spark):
    rng = random.Random(2)
    rows = [(0, k, "user", f"turn {k % 7}") for k in range(3000)] + [(101, k, "user", f"turn {k % 7}") for k in range(50)]
    rows += [(c, k, "bot", "same") for c in range(2, 400) for k in range(1 + c % 7)] + random_turns(rng, range(400, 450))
    rng.shuffle(rows)
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


@pytest.mark.parametrize("prime, bases", [(5, (2, 3)), (3, (2, 2))])
def test_collisions_are_split(spark, prime, bases):
    rows = random_turns(random.Random(3), [*range(0, 40), *range(100, 130)], words=4, longest=7)
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, TURNS), Rolling(prime, bases))) == brute(rows)


def test_snapshots_of_one_conversation(spark):
    # Each conversation leaves the one before it: chains hang on chains, 60 deep.
    rows = [(100 * c, k, "user", f"common {k}" if k < c else f"own {c}") for c in range(60) for k in range(c + 6)]
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_running_sums_over_partitions(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(100)) for k, n in ((1, 700), (2, 1), (3, 40), (4, 900)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {(r["k"], r["i"]): (r["idx"], r["sum0"]) for r in running(df, "k", [F.col("i").desc()], ["v"]).collect()}
    of = {(k, i): v for k, i, v in rows}
    last = {k: max(i for k2, i, _ in rows if k2 == k) for k in (1, 2, 3, 4)}
    assert got == {(k, i): (last[k] - i, sum(of[k, j] for j in range(i, last[k] + 1))) for k, i, _ in rows}
    roll = Rolling()
    got = {(r["k"], r["i"]): (r["idx"], r["sum0"], r["sum3"]) for r in running(df.withColumns({f"v{j}": F.col("v") for j in range(4)}), "k", [F.col("i")], ["v0", "v1", "v2", "v3"], roll).collect()}

    def sums(k, i):
        return tuple(sum(of[k, j] * pow(roll.bases[m], j, roll.prime) for j in range(i + 1)) % roll.prime for m in (0, 3))

    assert all(got[k, i] == (i, *sums(k, i)) for k, i in [(1, 0), (1, 699), (2, 0), (3, 17), (4, 450), (4, 899)])


def test_carried_sums():
    tails = [(0, 1, 2, 3, 30), (1, 2, 2, 4, 40), (3, 2, 5, 1, 10), (4, 6, 6, 2, 20), (5, 6, 7, 1, 1)]
    assert carried(tails, 1, None) == [(1, 2, 3, 30, 1), (3, 2, 7, 70, 1), (5, 6, 2, 20, 1)]


def test_digests_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rows = [(c, k, "bot", "same") for c in range(300) for k in range(2)]
    assert rows_of(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_query_matches_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op13_conversation_trie']})").fetchall()
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = rows_of(queries.op13_conversation_trie(spark, SF))
    assert got == brute(rows) == sorted(map(tuple, sql), key=str)
