import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.llm import (
    ann,
    components,
    decontamination,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    queries,
    sharding,
    token_output,
    toxicity,
)
from notewell.llm.line_dedup import LineRules

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, "  \n\t ", "en", None, 5),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (5, "same words here in this text", "de", "b", 28),
    (6, "same words here in this text", "de", "b", 28),
    (None, "no id at all for this row", "fr", "b", 25),
    (7, "long " * 30_000, "en", "a", 150_000),
]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def make_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# 1 line templates ------------------------------------------------------------------------------------------------


def test_line_templates(spark):
    rows = [(i, f"unique line number {chr(97 + i)} here\nUser id{i} logged in at {i}:00\nstatic footer text line", "en", "a", 0) for i in range(12)]
    rows += [(100 + i, f"job run for {name} is now done\nkeep this {name} sentence {name} alone", "en", "a", 0) for i, name in enumerate("ann bob cat dan eve fay gus hal ian joe".split())]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows), LineRules(min_docs=10)).collect()}
    assert all(out[i]["text"] == f"unique line number {chr(97 + i)} here" or out[i]["text"] == "" for i in range(12))
    assert all(out[i]["n_dropped"] >= 2 for i in range(12))
    assert all("job run for" not in out[100 + i]["text"] for i in range(10))
    few = line_dedup.dedup_lines(frame(spark, rows), LineRules(min_docs=13))
    assert few.agg(F.sum("n_dropped")).first()[0] == 0


def test_line_templates_odd_rows(spark):
    out = line_dedup.dedup_lines(frame(spark, ODD).withColumns({c: F.lit(1) for c in ("leaf", "_id", "gone", "kept", "row")}), LineRules(min_docs=2, min_tokens=1))
    assert {"leaf", "_id", "gone", "kept", "row"} <= set(out.columns)
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[1] == [(None, 0, 0)] and got[2] == [("", 1, 0)] and got[5] == [("", 1, 1)]
    assert got[4] == [("one", 1, 0)] * 2  # one document twice does not recur
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_long_lines_recur_from_two_documents(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    long, own = " ".join(word() for _ in range(60)), [" ".join(word() for _ in range(60)) for _ in range(2)]
    near = long.split()
    near[30] = "other"
    rows = [(i, f"{long}\nshort line of text\n{own[i]}", "en", "a", 0) for i in range(2)] + [(2, " ".join(near[:59] + ["end"]), "en", "a", 0)]
    form = [" ".join(["form", "of", "it", *[word()] * 1, *long.split()[:56]]) for _ in range(2)]
    rows += [(3 + i, form[i], "en", "a", 0) for i in range(2)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [out[i] for i in range(2)] == [f"short line of text\n{own[i]}" for i in range(2)]
    assert out[2] != "" and out[3] == out[4] == ""


def test_short_lines_recur(spark):
    rows = [(i, f"Read more\nown words of {'abcdefghijkl'[i] * 3} stay\nLes.", "en", "a", 0) for i in range(12)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert all(out[i] >= 2 for i in range(12))
    kept = line_dedup.dedup_lines(frame(spark, rows), line_dedup.SQL_RULES).collect()
    assert all("Read more" in r["text"] and "Les." in r["text"] for r in kept)


def test_a_leaf_has_several_templates(spark):
    """Planted lines: what recurs is known beforehand, and nothing else may go."""
    names = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    endings = ["in sports today", "about old films", "near some river"]
    rows, planted = [], {}
    for i in range(36):
        planted[i] = f"posted by user {names[i]} {endings[i % 3]}"
    for i in range(36, 45):  # nine documents only, in the same leaf
        planted[i] = f"posted by user {names[i]} with {names[i + 1]} {names[i + 2]}"
    for i in range(45, 57):  # a field between constants, one beside a digit
        planted[i] = f"posted by user {names[i]} at page {i}"
    for i, line in planted.items():
        rows.append((i, f"{names[i]} alone in {names[-i - 1]} {names[i // 2]} text\n{line}", "en", "a", 0))
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert {i for i, line in planted.items() if line not in out[i]} == {*range(36), *range(45, 57)}
    assert all(f"{names[i]} alone in {names[-i - 1]} {names[i // 2]} text" in out[i] for i in planted)


def dropped_by_definition(docs, rules):
    """What the module's docstring says, leaf by leaf."""
    lines = []  # document, line, masked tokens
    for doc_id, text in docs:
        for line in text.split("\n"):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.sub("[ \t\r]+", " ", line).strip(" ").split(" ")]
            if tokens != [""] and len(tokens) >= rules.min_tokens:
                lines.append((doc_id, line, tuple(tokens)))
    is_long = lambda t: rules.long_tokens is not None and len(t) > rules.long_tokens
    least = lambda t: rules.long_min_docs if is_long(t) else rules.min_docs
    docs_of = lambda some: len({x[0] for x in some})
    gone, leaves, same = set(), defaultdict(list), defaultdict(list)
    for x in lines:
        same[x[2]].append(x)
    for tokens, xs in same.items():
        if docs_of(xs) >= least(tokens):
            gone.update(x[:2] for x in xs)
        else:
            leaves[len(tokens), tokens[: rules.depth]] += xs
    for (n, _), xs in leaves.items():
        variants = {x[2] for x in xs}
        need, majority, shapes = least(xs[0][2]), {}, defaultdict(list)
        if docs_of(xs) < need:
            continue
        for p in range(n):
            top, c = max(Counter(v[p] for v in variants).items(), key=lambda e: (e[1], e[0]))
            if top != "<*>" and (2 * c > len(variants) if is_long(xs[0][2]) else 2 * c >= len(variants)):
                majority[p] = top
        fits = [x for x in xs if all(x[2][p] == t for p, t in majority.items())]
        if 2 * len(majority) >= n and docs_of(fits) >= need:
            gone.update(x[:2] for x in fits)
        weight = Counter()
        for v in variants:
            weight.update({(p, t): docs_of(same[v]) for p, t in enumerate(v) if t != "<*>"})
        for x in xs:
            shape = tuple((p, t) for p, t in enumerate(x[2]) if weight[p, t] >= need)
            if 2 * len(shape) >= n:
                shapes[shape].append(x)
        for some in shapes.values():
            if docs_of(some) >= need:
                gone.update(x[:2] for x in some)
    return gone


@pytest.mark.parametrize("query, rules", [("op1_recurring_lines", LineRules()), ("op1_line_templates", line_dedup.SQL_RULES)])
def test_line_queries_match_brute_force(spark, tmp_path, query, rules):
    rng = random.Random(31)
    forms = [["see", "also", "the", *rng.choices(["page", "old", "note", "?"], k=rng.choice([2, 4, 4]))] for _ in range(8)]
    forms += [["form", "one", "has", *[rng.choice(["x", "?"]) for _ in range(55)]] for _ in range(3)]
    fill = lambda form: " ".join(rng.choice(["red", "tan", "sky", "n7", "dim"]) if t == "?" else t for t in form)
    docs = []
    for i in range(140):
        lines = [fill(rng.choice(forms)) for _ in range(rng.randrange(1, 5))] + [" ".join(make_words(rng, rng.randrange(1, 7))) for _ in range(2)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), "en", "a", 0))
    want = dropped_by_definition([d[:2] for d in docs], rules)
    got = {r["doc_id"]: (r["n_dropped"], r["kept_md5"]) for r in queries.QUERIES[query](spark, tables(spark, tmp_path, documents=docs)).collect()}
    for i, text, *_ in docs:
        kept = [x for x in text.split("\n") if (i, x) not in want]
        assert got[i] == (len(text.split("\n")) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest())
    assert 50 < len(want) < sum(len(d[1].split("\n")) for d in docs) - 100


def test_rows_without_ids_drop_their_own_lines(spark):
    rows = [(None, f"this footer stands everywhere\nown {chr(97 + i)}{chr(98 + i)}", "en", "a", 0) for i in range(12)] * 2
    rows += [(i, "this footer stands everywhere", "en", "a", 0) for i in range(9)]
    out = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert len(out) == len(rows) and not any("footer" in r["text"] for r in out)  # all null ids are one document, the tenth
    assert Counter(r["text"] for r in out if r["doc_id"] is None) == Counter(r[1].split("\n")[1] for r in rows if r[0] is None)


# 2 neighbours ----------------------------------------------------------------------------------------------------


def brute_neighbours(vectors, k=5):
    out = {}
    for q in [i for i in vectors if i % 50 == 0]:
        a = np.array(vectors[q])
        s = {i: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) for i, b in ((i, np.array(v)) for i, v in vectors.items()) if i != q}
        out[q] = sorted(s, key=lambda i: (-s[i], i))[:k]
    return out


def found_neighbours(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    return got


def recall_of(got, want):
    assert got.keys() == want.keys()
    return np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    rows = queries.op2_rp_forest_neighbours(spark, folder).collect()
    assert recall_of(found_neighbours(rows), brute_neighbours(vectors)) >= 0.9
    for r in rows:
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - (a @ b) / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_neighbours_recall_of_a_deep_forest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 2000)  # the forest is fitted on half of the vectors
    monkeypatch.setattr(ann, "BLOCK", 64)  # leaves are several blocks
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(60, size=4000)] + rng.normal(size=(4000, 16)) * 0.6
    assert ann.fit_forest(x[:2000], 4000).depth >= 4
    rows = ann.clean_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = found_neighbours(ann.nearest(rows, rows.filter("vec_id % 50 = 0")).collect())
    assert recall_of(got, brute_neighbours(dict(enumerate(x)))) >= 0.9


def test_large_blocks_have_a_tree_of_their_own(monkeypatch):
    monkeypatch.setattr(ann, "WHOLE", 1024)
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    block = ann._Block(x, np.arange(6000), 5)
    assert block.inner is not None
    whole = list(ann.rank_block(x[:60], x, np.arange(6000), 5))
    hits = [len(set(a[1]) & set(b[1])) / 6 for a, b in zip(block.ranked(x[:60]), whole)]
    assert np.mean(hits) > 0.9


def test_neighbours_keep_ties_of_distinct_vectors(spark):
    base = np.array([0.3, -1.1, 2.0, 0.7])
    data = [(0, base.tolist())] + [(i, (base * (1 + i / 7)).tolist()) for i in range(1, 60)] + [(i, [1.0, float(i), float(-i), 2.0]) for i in range(60, 100)]
    rows = ann.clean_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = found_neighbours(ann.nearest(rows, rows.filter("vec_id % 50 = 0")).collect())
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]


def test_neighbours_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    same = [1.0, 2.0, 3.0]
    data = [(i, same) for i in range(0, 120)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120, 160)]
    bad = [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 2.0]), (503, [float("nan"), 1.0, 1.0]), (504, []), (None, same)]
    ragged = [(550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, [1.0])]
    rows = spark.createDataFrame(data + bad + data[:3] + ragged, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1))
    rows = ann.clean_vectors(rows)
    got = found_neighbours(ann.nearest(rows, rows.filter("vec_id % 50 = 0")).collect())
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and set(got) == {0, 50, 100, 150, 550} and got[550] == [551]
    two = ann.clean_vectors(spark.createDataFrame([(0, same), (1, same)], "vec_id long, embedding array<double>"))
    assert [tuple(r)[:3] for r in ann.nearest(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(two.limit(0), two.limit(0)).count() == 0


# 3 decontamination -----------------------------------------------------------------------------------------------


def test_leaks_with_edits(spark):
    rng = random.Random(3)
    item = " ".join(make_words(rng, 45, 5000))
    edited = item.replace(" w1", " W1", 2).upper().replace("W3", "W9", 2)
    far = " ".join(w if i % 4 else "changed" for i, w in enumerate(item.split()))
    filler = " ".join(make_words(rng, 200, 9000))
    rows = [(1, f"{filler} {item} {filler}", "en", "a", 0), (2, f"{filler}\n{edited}\n{filler}", "en", "a", 0), (3, f"{filler} {far}", "en", "a", 0), (4, filler, "en", "a", 0)]
    bench = spark.createDataFrame([(9, item), (10, "short"), (11, None), (9, item)], "item_id long, text string")
    out = {r["doc_id"]: r["leaks"] for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert [x["item_id"] for x in out[1]] == [9] and out[1][0]["edits"] == 0
    assert [x["item_id"] for x in out[2]] == [9] and 0 < out[2][0]["edits"] <= 0.06 * len(item)
    assert out[3] == [] and out[4] == []
    blocks = decontamination.find_leaks(frame(spark, rows), bench, block_bytes=100)
    assert {r["doc_id"] for r in blocks.filter(F.size("leaks") > 0).collect()} == {1, 2}


def edits_by_end(pattern: bytes, text: bytes) -> np.ndarray:
    """Least edits of the pattern against a stretch of text that ends at each position."""
    t, m = np.frombuffer(text, np.uint8), len(pattern)
    slope = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i in range(m):
        step = np.minimum(row + 1, np.append(i + 1, row[:-1] + (t != pattern[i])))
        row = np.minimum.accumulate(step - slope) + slope
    return row


def brute_leaks(docs, items):
    """(doc, item) -> least edits over the windows that are within their budget."""
    out = {}
    for i, text in docs:
        whole = decontamination.normalize(text)
        for item, pattern in items:
            b = decontamination.normalize(pattern)
            if 0 < len(b) < decontamination.WORDS_BELOW:
                if f" {b.decode()} " in f" {whole.decode()} ":
                    out[i, item] = 0
                continue
            cuts = [(0, len(b))] if len(b) <= 300 else [*((s, s + 200) for s in range(0, len(b) - 200, 100)), (len(b) - 200, len(b))]
            for s, e in cuts if b else ():
                least = int(edits_by_end(b[s:e], whole).min())
                if least <= (e - s) * 6 // 100:
                    out[i, item] = min(least, out.get((i, item), 99))
    return out


def tables(spark, folder, **rows):
    schemas = {"documents": DOC, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, data in rows.items():
        spark.createDataFrame(data, schemas[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_leak_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(14)
    lengths = [3, 5, 7, 8, 9, 11, 12, 15, 16, 17, 20, 23, 24, 30, 31, 32, 33, 34, 35, 36, 49, 50, 51, 66, 67, 84, 120, 200, 299, 300, 301, 450, 700]
    items = [(k, "".join(rng.choice("abcdefghijkl ") for _ in range(n)).replace("  ", "xy").replace(" ", "z", 1).strip() or "q") for k, n in enumerate(lengths)]
    items += [(90, "a" * 50), (91, None), (92, "  "), (0, items[0][1])]

    def changed(text, n):
        text = list(text)
        for _ in range(n):
            k = rng.randrange(len(text))
            rng.choice([lambda: text.insert(k, "Q"), lambda: text.__setitem__(k, "w"), lambda: text.pop(k) if len(text) > 1 else None])()
        return "".join(text)

    filler = lambda: " ".join("".join(rng.choice("mnopqrstuv") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 60)))
    docs = []
    for k, text in items[: len(lengths)]:
        for extra in (0, 0, 1, -1):
            n = max(0, len(text) * 6 // 100 + extra) if extra or rng.random() < 0.7 else 0
            docs.append(f"{filler()} {changed(text.upper(), n)}\n{filler()}")
        if len(text) > 300:
            docs.append(f"{filler()} {text[len(text) // 2 - 130 : len(text) // 2 + 130]} {filler()}")
    docs = list(enumerate([*docs, None, "", "a" * 49, "ab" * 40, "b" + "a" * 300]))
    folder = tables(spark, tmp_path, documents=[(i, t, "en", "a", 0) for i, t in docs], benchmark=items)
    got = queries.op3_benchmark_leaks(spark, folder).collect()
    want = brute_leaks(docs, [(i, t) for i, t in items if t])
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(got) == len(want) and len(want) > 80
    text, of = dict(docs), dict(items)
    for r in got:  # the offsets cut out exactly the occurrence
        part = decontamination.normalize(text[r["doc_id"]])[r["start"] : r["end"]]
        b = decontamination.normalize(of[r["item_id"]])
        cuts = [b] if len(b) <= 300 else [b[s : s + 200] for s in [*range(0, len(b) - 200, 100), len(b) - 200]]
        whole = [np.concatenate([[0], row])[-1] for row in (global_edits(c, part) for c in cuts)]
        assert min(whole) == r["edits"]


def global_edits(a: bytes, b: bytes) -> list[int]:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_leaks_in_pieces_and_blocks(spark, monkeypatch):
    rng = random.Random(15)
    item = " ".join(make_words(rng, 30, 5000))
    text = " ".join([*make_words(rng, 3000, 5000), item, *make_words(rng, 2000, 5000)])
    bench = decontamination.Benchmark.build([(1, item)])
    want = bench.leaks([text, "", item])
    assert [x[0]["edits"] if x else None for x in want] == [0, None, 0]
    monkeypatch.setattr(decontamination, "PIECE", 700)
    monkeypatch.setattr(decontamination, "HITS", 50)
    assert bench.leaks([text, "", item]) == want


def test_a_common_gram_takes_bounded_memory():
    import tracemalloc

    bench = decontamination.Benchmark.build([(1, "a" * 100)])
    tracemalloc.start()
    found = bench.leaks(["a" * 200_000])
    assert found[0][0]["edits"] == 0 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")
    out = decontamination.find_leaks(frame(spark, ODD).withColumn("_leaks_0", F.lit(1)).withColumn("_row0", F.lit(2)), bench, block_bytes=20)
    assert {"_leaks_0", "_row0"} <= set(out.columns) and out.count() == len(ODD)
    out = decontamination.find_leaks(frame(spark, ODD), bench)
    assert out.count() == len(ODD) and out.filter(F.size("leaks") > 0).count() == 0
    assert decontamination.find_leaks(frame(spark, []), bench).count() == 0
    assert decontamination.find_leaks(frame(spark, ODD), bench.limit(0)).filter(F.size("leaks") > 0).count() == 0


# 4 sharding ------------------------------------------------------------------------------------------------------


def test_shards(spark):
    got = queries.op4_rendezvous_shards(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got["shard"].between(0, 39).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 40)).all()
    for r in got.itertuples():
        raw = docs.loc[r.doc_id, "text"].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_weighted_shards_and_odd_rows(spark):
    many = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = {r["shard"]: r["count"] for r in sharding.assign_shards(many, [1, 2, 0, 5]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] / n[0] - 2) < 0.25 and abs(n[3] / n[0] - 5) < 0.6
    out = sharding.number_slots(sharding.assign_shards(frame(spark, ODD), [1.0]), ties=("text",), cells=4)
    assert sorted(r["slot"] for r in out.collect()) == list(range(len(ODD)))
    assert sharding.number_slots(sharding.assign_shards(frame(spark, []), [1.0])).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [0.0])


@pytest.mark.parametrize("hot_rows", [2, 40, 10**6])
def test_slots_of_repeated_keys(spark, hot_rows):
    rows = [(None, f"t{i % 3}", "en", "a", 0) for i in range(90)] + [(5, None, "en", "a", 0)] * 60 + [(i, f"t{i}", "en", "a", 0) for i in range(100)]
    docs = frame(spark, rows).repartition(7).withColumns({c: F.lit(c) for c in ("slot", "_cell", "cell", "row", "n", "start", "part", "_start", "_row")})
    out = sharding.number_slots(sharding.assign_shards(docs, [1.0, 1.0]), ties=("text",), cells=4, hot_rows=hot_rows)
    assert sorted(out.columns) == sorted([*docs.columns, "shard"])
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert all(r[c] == c for c in ("_cell", "cell", "row", "n", "start", "part", "_start", "_row"))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = lambda rows: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows)
    again = sharding.assign_shards(docs.coalesce(1), [1.0, 1.0])
    assert where(got) == where(sharding.number_slots(again, ties=("text",), cells=4, hot_rows=hot_rows).collect())


def test_shard_query_matches_brute_force(spark):
    import math

    def least(i, n):
        def cost(k):
            digits = hashlib.md5(f"shard:{'' if i is None else i}:{k}".encode()).hexdigest()[:13]
            return -math.log((int(digits, 16) + 0.5) / 16**13)

        return min(range(n), key=lambda k: (cost(k), k))

    got = queries.op4_rendezvous_shards(spark, SF).collect()
    assert all(r["law"] == "key" and r["shard"] == least(r["doc_id"], 40) and r["grown_shard"] == least(r["doc_id"], 41) for r in got)


# 5 mixing --------------------------------------------------------------------------------------------------------


def deal(budget, nodes):
    """nodes: name -> (capacity, weight). Water level, one full child at a time."""
    out, left = {}, dict(nodes)
    while left:
        w = sum(x[1] for x in left.values())
        full = [k for k, (cap, weight) in left.items() if cap * w <= weight * budget]
        if not full:
            return out | {k: weight * budget // w for k, (_, weight) in left.items()}
        k = min(full, key=lambda k: left[k][0] / left[k][1])
        out[k] = left.pop(k)[0]
        budget -= out[k]
    return out


def test_budgets(spark):
    rng = random.Random(5)
    leaves = [(f"d{i % 3}", f"l{i % 2}", f"s{i}", rng.randrange(0, 400)) for i in range(24)]
    plan = mixing.MixPlan(share=(9, 10), max_epochs=2, domain_weights={"d0": 5, "d1": 2}, lang_weights={"l0": 3}, source_weights={"s3": 7})
    got = {tuple(r)[:3]: r["quota"] for r in mixing.leaf_budgets(frame(spark, leaves, "mix_domain string, mix_lang string, mix_source string, tokens long"), plan).collect()}
    cap = {x[:3]: 2 * x[3] for x in leaves}
    weight = lambda table, k: table.get(k, 1)
    total = sum(x[3] for x in leaves) * 9 // 10
    of = lambda *k: sum(v for key, v in cap.items() if key[: len(k)] == k)
    top = deal(total, {d: (of(d), weight(plan.domain_weights, d)) for d in {k[0] for k in cap}})
    for d, b in top.items():
        langs = deal(b, {l: (of(d, l), weight(plan.lang_weights, l)) for l in {k[1] for k in cap if k[0] == d}})
        for l, c in langs.items():
            want = deal(c, {s: (cap[d, l, s], weight(plan.source_weights, s)) for s in {k[2] for k in cap if k[:2] == (d, l)}})
            assert {s: got[d, l, s] for s in want} == want


def test_mix_reads_the_longest_prefix(spark):
    plan = queries.MIX
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, plan).collect()}
    narrow = mixing.with_leaf(docs).select(*mixing.LEVELS, "doc_id", mixing.count_tokens(F.col("text")).alias("n_tokens"))
    quota = {tuple(r)[:3]: r["quota"] for r in mixing.leaf_budgets(narrow.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan).collect()}
    leaves = defaultdict(list)
    for r in narrow.collect():
        leaves[tuple(r)[:3]].append((r["doc_id"], r["n_tokens"]))
    import hashlib

    for leaf, rows in leaves.items():
        left, epoch, copies = quota[leaf], 0, Counter()
        while left > 0 and epoch < plan.max_epochs:
            for i, n in sorted(rows, key=lambda r: (hashlib.md5(f"{plan.seed}:{epoch}:{r[0]}".encode()).hexdigest(), r[0])):
                if n > left:
                    left = 0
                    break
                left -= n
                copies[i] += 1
            epoch += 1
        assert {i: got[i] for i, _ in rows if i in got} == dict(copies)


def test_mix_odd_rows(spark):
    out = mixing.mix(frame(spark, ODD).withColumn("epochs", F.lit(1)), mixing.MixPlan(share=(1, 1), max_epochs=1))
    assert {r["doc_id"] for r in out.collect()} >= {4, 5, 6, 7, None} and "epochs" in out.columns
    assert mixing.mix(frame(spark, []), mixing.MixPlan()).count() == 0


# 6 Jaccard join --------------------------------------------------------------------------------------------------


def brute_components(rows, n_words=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n_words]) for k in range(len(w) - n_words + 1)} if len(w) >= n_words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("frequent, rounds", [(50, 1), (4, 1), (2, 40)])
def test_components_match_brute_force(spark, monkeypatch, frequent, rounds):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)  # with 40, near copies have frequent tokens only
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 6)
    rng = random.Random(frequent)
    passage = make_words(rng, 60, 10**6)
    rows = []
    for g in range(12):
        base = make_words(rng, rng.choice([9, 12, 30, 80, 200, 600]), 10**6)
        if g % 3 == 0:
            base = base[: len(base) // 6] + passage
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, len(w) // 40])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += ["", None, "one", "One", "one two", "a b c", "A B\tc"]
    docs = [(i * 3, t, "en", "a", 0) for i, t in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_components([(d[0], d[1]) for d in docs])


def test_components_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_ngram_jaccard(spark, SF).collect()}
    assert got == brute_components([tuple(r) for r in docs.collect()])


def test_components_odd_rows(spark):
    out = [tuple(r) for r in jaccard_join.near_duplicates(frame(spark, ODD)).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 4, 5), (6, 4, 5), (None, 5, None), (7, 1, 7)], key=str)
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(100, 103).selectExpr("id a", "103L b"))
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


# 7 token output --------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    odd = ["<|endoftext|>a b<|endoftext|>", "Σίσυφος ΣΑΣ H̱ello × 3÷4", "don't 'stop \"'s ... l'été ÉCOLE", "\x1c\x1d x y z日本 12.5%"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*odd, "", None])], "doc_id long, text string"))
    path = token_output.write_tokens(docs, str(tmp_path / "t"), files=3)
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    tokenizer = Tokenizer.from_file(token_output.tokenizer_path())
    want, start = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_output.token_index(spark, path).collect()) == want
    found = token_output.read_tokens(spark, path).filter("doc_id = 10002").collect()
    assert len(found) == 1 and found[0]["ids"][-1] == token_output.END_ID


def brute_token_rows(rows, path=None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or token_output.tokenizer_path())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_token_query_is_direct_encoding(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op7_token_orc(spark, SF).collect()) == brute_token_rows(rows)


def test_words_encode_as_whole_texts():
    import pyarrow as pa

    encoder = token_output.TextEncoder(token_output.tokenizer_path(), max_words=2000)
    assert encoder.by_word
    rng = random.Random(12)
    letters = "aAbzßéÉèÀçñÑüøœŒżЖжςΣσ日本한\u0301\u0327\u00a0\u2003\u200b\u0130İıﬁ½²٣९🙂😀👩‍👩'’\"`.,;:!?-_*#/\\|<>()[]{}@&%$+=~^0123456789×÷"
    texts = []
    for _ in range(1500):
        words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 25))]
        words += rng.choices(["don't", "IT'S", "they'll", "<|endoftext|>", "x<|startoftext|>y", "l'été", "'s", "''re", "naïve,", "(a1b2)", "\x1c", "\x85"], k=3)
        rng.shuffle(words)
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", " \r\n", "\x0b", "\x0c "]) for w in words))
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for start in range(0, len(texts), 100):
        ids, counts = encoder.encode(pa.array(texts[start : start + 100]))
        assert ids.tolist() == [i for e in want[start : start + 100] for i in (*e.ids, token_output.END_ID)]
        assert counts.tolist() == [len(e.ids) + 1 for e in want[start : start + 100]]


def test_another_tokenizer_encodes_whole_texts(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_output.words_are_independent(path) and token_output.words_are_independent(token_output.tokenizer_path())
    rows = [(1, " two  blanks\n\nhere "), (2, None), (3, "Don't")]
    written = token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "b"), tokenizer=path)
    assert sorted(tuple(r) for r in token_output.token_index(spark, written).collect()) == brute_token_rows(rows, path)


def test_orc_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    path = token_output.write_tokens(rows, str(tmp_path / "t"), files=3)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    firsts, files = [], sorted(tmp_path.glob("t/part-*.orc"))
    assert len(files) == 3
    for f in files:
        orc = jvm.org.apache.orc.OrcFile
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == 2000 and reader.getStripes().size() >= 1
        stream_kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= stream_kinds
        encodings = {str(c.getKind()) for c in reader.rows().readStripeFooter(reader.getStripes().get(0)).getColumnsList()}
        assert "DIRECT_V2" in encodings  # integer run lengths
        low = reader.getStatistics()[3]
        firsts.append((low.getMinimum(), low.getMaximum()))
    assert all(a[1] < b[0] for a, b in zip(firsts, firsts[1:]))
    found = token_output.read_tokens(spark, path).filter("doc_id = 17000")
    assert "EqualTo(doc_id,17000)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
    read = token_output.read_tokens(spark, path).filter("doc_id between 17000 and 17010")
    assert read.count() == 11


def test_token_files_odd_rows(spark):
    got = sorted((tuple(r)[0] or 0, r["n_tokens"]) for r in token_output.token_table(frame(spark, ODD).withColumn("file", F.lit(1))).collect())
    assert len(got) == len(ODD) and got[1:4] == [(1, 1), (2, 1), (3, 1)]
    assert token_output.token_table(frame(spark, [])).count() == 0


# 8 licenses ------------------------------------------------------------------------------------------------------


def test_licenses_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs).collect()}
    words = lambda t: re.findall("[a-z0-9\u0080-￿]+", t.lower())
    want = set()
    for r in docs.collect():
        text = " " + " ".join(words(r["text"])) + " "
        for name, templates in license_scan.TEMPLATES.items():
            if any(f" {' '.join(words(t))} " in text for t in templates):
                want.add((r["doc_id"], name))
    assert want and want <= got
    assert len(got - want) <= 2  # parts of a notice over the containment bound


def test_licenses_partial_and_odd_rows(spark):
    notice = license_scan.TEMPLATES["MIT"][2]
    cut = " ".join(notice.split()[:-3])
    rows = [(1, f"code {'x ' * 50} {notice} rest", "en", "a", 0), (2, cut, "en", "a", 0), (3, " ".join(notice.split()[:10]), "en", "a", 0)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT"}
    assert license_scan.scan_licenses(frame(spark, ODD)).count() == 0
    assert license_scan.scan_licenses(frame(spark, rows), templates={}).count() == 0


def test_license_of_repeated_ids_does_not_depend_on_order(spark):
    rows = [(1, "words of no notice " * 9, "en", "a", 0), (1, "Licensed under the MIT License.", "en", "a", 0), (1, "Released under the MIT Licence.", "en", "a", 0)]
    for some in (rows, rows[::-1]):
        docs = frame(spark, some).withColumnRenamed("doc_id", "template").withColumn("share", F.lit(1)).coalesce(1)
        assert [tuple(r) for r in license_scan.scan_licenses(docs, keys=("template",)).collect()] == [(1, "MIT", 1.0, 0)]


def test_short_notices_are_always_found(spark):
    rng = random.Random(23)
    templates = {"three": ("All rights reserved.",), "four": ("no part may be",), "two": ("public domain",)}
    rows, want = [], set()
    for i in range(300):
        words, which = make_words(rng, 30, 10**6), rng.choice([*templates, "none"])
        if which != "none":
            at = rng.randrange(31)
            words[at:at] = templates[which][0].split()
            if which != "two" or len(words) == 2:  # two words are a shingle only of a text that has no others
                want.add((i, which, at))
        rows.append((i, " ".join(words), "en", "a", 0))
    rows.append((300, "Public domain!", "en", "a", 0))
    got = license_scan.scan_licenses(frame(spark, rows), templates).collect()
    assert {(r["doc_id"], r["license"], r["first_word"]) for r in got} == want | {(300, "two", 0)} and len(want) > 100


def test_license_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(17)
    docs = []
    for i in range(120):
        name = rng.choice(sorted(license_scan.TEMPLATES))
        words = rng.choice(license_scan.TEMPLATES[name]).split()
        cut = words[: len(words) - rng.choice([0, 0, 1, 2, 4])]
        docs.append((i, " ".join([*make_words(rng, rng.randrange(0, 40)), *cut, *make_words(rng, rng.randrange(0, 40))]), "en", "a", 0))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in queries.op8_license_scan(spark, tables(spark, tmp_path, documents=docs)).collect()}
    words_of = lambda t: re.findall("[a-z0-9\u0080-￿]+", t.lower())
    shingles = lambda w: [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [tuple(w)] if w else []
    want = {}
    for i, text, *_ in docs:
        own = shingles(words_of(text))
        for name, templates in license_scan.TEMPLATES.items():
            for t in templates:
                known = set(shingles(words_of(t)))
                share = len(known & set(own)) / len(known)
                if share >= license_scan.CONTAINMENT:
                    at = min(k for k, x in enumerate(own) if x in known)
                    old = want.get((i, name), (0.0, 1 << 30))
                    want[i, name] = (max(old[0], share), min(old[1], at))
    assert got == want and len(want) > 60


# 9 language ------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and both["score"].between(0, 1).all()
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_language_odd_rows(spark):
    docs = frame(spark, ODD + [(8, "12 34 --", "en", "a", 0)])
    model = language_id.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3, 8)] == ["und"] * 4 and got[5] == "de" and got[7] == "en"
    none = language_id.fit(frame(spark, []))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(docs, none).collect()} == {("und", 0.0)}


def test_language_query_matches_brute_force(spark, tmp_path):
    """Scores of the query by counting n-grams of each text one by one, with the fitted probabilities."""
    rng = random.Random(16)
    docs = [(i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(rng.randrange(1, 40))), lang, "s", 0) for i, (lang, a) in enumerate([("aa", "abcdeé"), ("bb", "cdefgЖ"), ("cc", "efghiß")] * 30)]
    folder = tables(spark, tmp_path, documents=docs)
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, folder).collect()}
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    langs = sorted({d[2] for d in learned})
    counts = {lang: Counter() for lang in langs}

    def grams_of(text):
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        padded = np.concatenate([points, np.full(3, 32, np.uint32)])
        return [int(language_id._buckets(padded[i : i + size], size, 1)[0]) for size in (1, 2, 3) for i in range(len(points))]

    for d in learned:
        counts[d[2]].update(grams_of(d[1]))
    log = {}
    for lang in langs:
        per_size = [sum(v for b, v in counts[lang].items() if b >> 15 == k) + 0.5 * 2**15 for k in range(3)]
        log[lang] = lambda b, c=counts[lang], n=per_size: np.log((c[b] + 0.5) / n[b >> 15])
    for i, text, *_ in docs:
        total = np.array([np.log(sum(d[2] == lang for d in learned) / len(learned)) + sum(log[lang](b) for b in grams_of(text)) for lang in langs])
        p = np.exp(total - total.max())
        assert got[i]["lang_pred"] == langs[int(total.argmax())] and abs(got[i]["score"] - p.max() / p.sum()) < 1e-4


def test_long_texts_are_scored_in_full(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(("a", "b"), (rng.normal(size=(3 << language_id.BUCKET_BITS, 2)) / 500).astype(np.float32), np.zeros(2))
    texts = ["".join(rng.choice(list("abcdé "), 3000)), "short", None, ""]
    names, scores = language_id.score_texts(model, texts)
    assert names[2:] == ["und", "und"] and 0.5 < scores[0] < 1
    monkeypatch.setattr(language_id, "PIECE", 100)
    again = language_id.score_texts(model, texts)
    assert again[0] == names and np.allclose(again[1], scores)
    half = language_id.score_texts(model, [texts[0][:1500]])[1]
    assert abs(half[0] - scores[0]) > 1e-6


def test_every_language_is_learned(spark):
    rows = [(i, f"text {chr(97 + i % 26)}{i}{i} of its own", f"l{i:03d}", "s", 0) for i in range(400)]
    model = language_id.fit(frame(spark, rows), sample_docs=800)
    assert len(model.languages) == 400 and model.bits == 14
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame(spark, rows), model).collect()}
    assert np.mean([got[i] == f"l{i:03d}" for i in range(400)]) > 0.9


# 10 toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns_words(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        words = make_words(rng, rng.randrange(5, 60), 300)
        if bad := i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words), "en", "a", 0))
        marks.append((i, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, where=F.col("doc_id") % 5 != 0)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(0, 600, 5)]
    assert np.mean([(out[i]["toxic_score"] >= toxicity.THRESHOLD) == bool(marks[i][1]) for i in held]) > 0.9
    assert set(model.thresholds) == {"en"} and all(0 <= r["toxic_score"] <= 1 for r in out.values())


def test_toxicity_odd_rows(spark):
    docs = frame(spark, ODD).withColumn("toxic_flag", F.lit(3))
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(ODD) and len({r["toxic_score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_long_texts_are_pooled_in_pieces(monkeypatch):
    model = toxicity.train([np.arange(1, 9, dtype=np.int32)] * 12 + [np.arange(20, 29, dtype=np.int32)] * 12, np.array([1.0] * 12 + [0.0] * 12, np.float32))
    text = np.concatenate([np.arange(20, 29, dtype=np.int32)] * 40 + [np.arange(1, 9, dtype=np.int32)])
    whole = toxicity.score_ids(model, [text])
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(toxicity.score_ids(model, [text]), whole)


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    """Scores of the query by sliding every filter over the words of each text one by one."""
    rng = random.Random(18)
    docs, marks = [], []
    for i in range(400):
        words = make_words(rng, rng.randrange(0, 50), 300)
        if bad := i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vile", "nasty"]))
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), "s", 0))
        marks.append((i, 1, int(bad)))
    marks += [marks[0], (500, 1, 1), (None, 1, 0), (7, 1, None)]
    docs += [(600, None, None, None, 0), (601, "", "en", "s", 0), (None, "vile words", "en", "s", 0)]
    folder = tables(spark, tmp_path, documents=docs, labels=marks)
    got = queries.op10_toxicity(spark, folder).collect()
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    model = toxicity.fit(table("documents"), table("labels"), where=F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1)

    def score(text):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        x = [model.embedding[1 + zlib.crc32(w.encode()) % (2**toxicity.BUCKET_BITS - 1)] for w in words]
        x += [np.zeros(toxicity.DIM)] * 2
        z, at = model.out_bias, 0
        for k, width in enumerate((1, 2, 3)):
            for f in range(toxicity.FILTERS):
                peak = max(
                    sum(float(x[p + j] @ model.kernel[:, at + j * toxicity.FILTERS + f]) if p + j < len(x) else 0.0 for j in range(width))
                    for p in range(len(x))
                )
                n = k * toxicity.FILTERS + f
                z += max(0.0, peak + model.bias[n]) * model.out[n]
            at += width * toxicity.FILTERS
        return 1 / (1 + np.exp(-z))

    by_id = {i: t for i, t, *_ in docs}
    assert len(got) == len(docs)
    for r in got:
        assert abs(r["score"] - score(by_id[r["doc_id"]])) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"])
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(right) > 90 and np.mean(right) > 0.9


# pipeline --------------------------------------------------------------------------------------------------------


def texts_kept(rows, n_words=5, percent=80):
    """(doc_id, text) of the rows that stay, by comparing all pairs of rows: the first of each group, and all without words."""
    named = list(enumerate(rows))
    comps = brute_components([(i, r[1]) for i, r in named], n_words, percent)
    groups = defaultdict(list)
    for i, r in named:
        groups[comps[i][1] if comps[i][0] else -1 - i].append(r[:2])
    return groups


def test_pipeline_drops_copies_of_five_words(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = p.drop_copies(spark, docs, SF)
    assert kept.columns == list(p.COLUMNS)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(rows, 5, 80).items() if c == i}


def test_pipeline_copies_are_decided_row_by_row(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    text = lambda n: " ".join(make_words(rng, n, 10**6))
    same, own = text(40), [text(40) for _ in range(6)]
    rows = [(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (5, own[4])]
    rows += [(7, same), (7, same), (8, same), (None, same), (None, own[5]), (None, own[5])]
    rows += [(9, ""), (9, ""), (9, None), (None, None), (None, " ")]
    kept = [(r["doc_id"], r["text"]) for r in p.drop_copies(spark, frame(spark, [(*r, "en", "a", 0) for r in rows]), SF).collect()]
    want = [*rows[:5], (7, same), (None, own[5]), *rows[11:]]
    assert Counter(kept) == Counter(want)
    assert Counter(len(g) for g in texts_kept(rows).values()) == Counter([1] * 10 + [4, 2])
    assert p.drop_copies(spark, frame(spark, []), SF).count() == 0


def test_pipeline_drops_leaked_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaked = {r["doc_id"] for r in queries.op3_benchmark_leaks(spark, SF).select("doc_id").collect()}
    clean = p.drop_leaks(spark, docs, SF)
    assert clean.columns == list(p.COLUMNS) and leaked
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - leaked


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    docs, none = frame(spark, ODD).withColumn("leaks", F.lit(1)).withColumn("copies", F.lit(2)), frame(spark, [])
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, none, SF).count() == 0
        assert (out.columns == list(p.COLUMNS)) == (name != "token_output")
        ids = Counter(r["doc_id"] for r in out.collect())
        if name in ("toxicity", "benchmark_decontamination", "token_output"):
            assert ids == Counter(r[0] for r in ODD)
        elif name == "ngram_jaccard_join":
            assert ids == Counter([1, 2, 3, 4, 5, None, 7])
        else:
            assert set(ids) <= {r[0] for r in ODD} and max(ids.values()) <= 2 * p.MIX.max_epochs


def test_pipeline_run_is_its_stages_one_by_one(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    flagged = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("toxic_flag").collect()}
    kept = [(i, t) for i, t in rows.items() if i not in flagged]
    firsts = {i for i, (_, c) in brute_components(kept, 5, 80).items() if c == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bench = decontamination.Benchmark.build(items)
    clean = [(i, t) for i, t in kept if i in firsts and not bench.leaks([t])[0]]
    left = docs.filter(F.col("doc_id").isin([i for i, _ in clean]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left, p.MIX).collect()}
    want = brute_token_rows([(i, t) for i, t in clean for _ in range(copies.get(i, 0))])
    assert sorted(tuple(r) for r in p.run(spark, SF).collect()) == sorted(want) and 0 < len(flagged) < len(rows)
