import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewell.llm import queries, token_alignment
from notewell.llm.token_alignment import Aligner, align, default_tokenizers, shared_cuts

SF = "/root/testdata/sf0.001"
ODD = [
    "one  two\n\n three\t four \n",
    " leading and trailing ",
    "\n",
    " ",
    "tab\t\n \tmix\r\n end\x0b \x0c",
    "a▁b is no space",
    "▁",
    "émile naïve ünïcode — “quotes” 漢字かな交じり文 🙂🙂‍🔥",
    "<|endoftext|> <s> </s> <unk> <0x0A>",
    "é ́x  nbsp em   line ᠎ vowel \x1c \x85 x\x00y",
    "it's we'll I'd 12345 3.14 ----- !!?? {x}();\r\n\r \r y",
    "long-" * 20_000 + " " + "word " * 20_000,
]


@pytest.fixture(scope="module")
def aligner():
    found = Aligner(default_tokenizers())
    assert found.by_piece
    return found


def direct(aligner, text):
    """(A ids, B ids) of a whole text, or nothing."""
    if not text:
        return [], []
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    raw = (" " + text).encode()
    decoded = b"".join(token_alignment.byte_level_bytes(aligner.a.id_to_token(i)) for i in a)
    pieces = [aligner.b.id_to_piece(i) for i in b]
    of_b = b"".join(bytes.fromhex(p[3:5]) if aligner.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces))
    return (a, b) if decoded == raw == of_b else ([], [])


def brute_groups(aligner, a, b):
    """Runs of ids between shared ends, by walking both lists."""
    size_a = [len(token_alignment.byte_level_bytes(aligner.a.id_to_token(i))) for i in a]
    size_b = [1 if aligner.b.is_byte(i) else len(aligner.b.id_to_piece(i).replace("▁", " ").encode()) for i in b]
    out, i, j = [], 0, 0
    while i < len(a):
        x, y, at_a, at_b = i + 1, j + 1, size_a[i], size_b[j]
        while at_a != at_b:
            if at_a < at_b:
                at_a, x = at_a + size_a[x], x + 1
            else:
                at_b, y = at_b + size_b[y], y + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def brute_rows(aligner, rows):
    tokens = [direct(aligner, t) for _, t in rows]
    groups = [brute_groups(aligner, a, b) for a, b in tokens]
    links = [[(x[-1], y[-1]) for x, y in g] for g in groups]
    counts = Counter(p for one in links for p in one)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (doc_id, _), (a, b), g, l in zip(rows, tokens, groups, links):
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(line.encode()).hexdigest() if g else ""
        best = sum(counts[p] == most[p[1]] for p in l)
        out.append((doc_id, len(a), len(b), len(g), len(l), best, sum(counts[p] for p in l), digest))
    return sorted(out, key=str)


def test_cuts_of_small_bitsets():
    cuts, a, b = shared_cuts(np.array([1, 2, 3, 4]), np.array([3, 2, 1, 4]))
    assert cuts.tolist() == [3, 6, 10] and a.tolist() == [2, 3, 4] and b.tolist() == [1, 3, 4]
    rng = np.random.default_rng(0)
    x = rng.integers(1, 9, 5000)
    ends = np.cumsum(x)
    keep = np.sort(rng.choice(len(ends) - 1, 2000, replace=False))
    y = np.diff(np.concatenate([ends[keep], ends[-1:]]), prepend=0)
    cuts, a, b = shared_cuts(x, y)
    assert cuts.tolist() == [*ends[keep].tolist(), ends[-1]] and b.tolist() == list(range(1, 2002))
    assert a.tolist() == [*(keep + 1).tolist(), 5000]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab é'é1.\n\t \r\x0b  ▁漢🙂\x00", "  ", "the", " and", "'s", "\n\n", "<s>", " \n", "\x85", "\x1c"]), max_size=30))
def test_pieces_encode_as_whole_texts(aligner, parts):
    text = "".join(parts)
    aligner.reset()
    of, lengths = aligner.numbers([text])
    a, b = direct(aligner, text)
    want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in brute_groups(aligner, a, b))
    sound = bool(len(of)) and not aligner.n[3, of].any()
    aligner.write_texts()
    assert "".join(aligner.cut(text)) == " " + text
    assert (";".join(aligner.text[i] for i in of) if sound else "") == want


@pytest.mark.parametrize("most_pairs, most_pieces", [(2_000_000, 200_000), (40, 3)])
def test_rows_match_brute_force(spark, monkeypatch, aligner, most_pairs, most_pieces):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", most_pairs)
    monkeypatch.setattr(token_alignment, "MAX_PIECES", most_pieces)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[0]), (3, ODD[0]), (None, "no id"), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    assert sorted((tuple(r) for r in align(docs).collect()), key=str) == brute_rows(aligner, rows)
    assert align(docs.limit(0)).count() == 0


def test_whole_texts_of_other_tokenizers(aligner):
    whole = Aligner(default_tokenizers(), by_piece=False)
    for text in ODD:
        of, _ = whole.numbers([text])
        a, b = direct(aligner, text)
        assert len(of) == 1 and (whole.n[0, of[0]], whole.n[1, of[0]]) == (len(a), len(b))


def test_query_matches_brute_force(spark, aligner):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = queries.op12_token_alignment(spark, SF).select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_rows(aligner, rows)
