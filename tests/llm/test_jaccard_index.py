"""What the index of the similarity join moves: keys that cannot lead to a link, and links that need every key."""

import numpy as np
import pytest

from notewell.llm import jaccard_join


class Shared:
    def __init__(self, value):
        self.value = value


def keys_of(bounds, sets, frequent):
    import pyarrow as pa

    every = np.full(1 << 19, 255, np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(range(len(sets)), pa.int64())], names=["toks", "node"])
    found = [{} for _ in sets]
    for part in jaccard_join._postings(bounds, Shared(frequent), Shared(every))(iter([batch])):
        for row in part.to_pylist():
            found[row["node"]][row["key"]] = row["most"]
    return found


@pytest.mark.parametrize("often", [0, 0b1, 0b1110, 0b11111111])  # which eighths of the tokens are frequent
@pytest.mark.parametrize("percent", [80, 90])
def test_each_link_has_a_key_that_leaves_room_for_it(percent, often):
    bounds, rng = jaccard_join.Bounds(percent), np.random.default_rng(percent + often)
    frequent = np.full(1 << 19, often, np.uint8)
    for n in [9, 10, 12, 19, 20, 37, 64, 100, 171, 256, 700]:
        for _ in range(12):
            both = int(rng.integers(-(-percent * n // 100), n + 1))
            other = both * 100 // percent - n + both  # of the other set: the most that leave a link
            other = int(rng.integers(both, max(both, other) + 1))
            tokens = rng.integers(0, 2**64, n + other - both, np.uint64)
            a, b = np.sort(tokens[:n]), np.sort(np.concatenate([tokens[:both], tokens[n:]]))
            assert 100 * both >= percent * (n + other - both)
            one, two = keys_of(bounds, [a, b], frequent)
            room = [min(one[k], two[k]) for k in one.keys() & two.keys()]
            assert max(room, default=0) >= both, (n, other, both)


def test_sets_that_cannot_link_make_no_group(spark, monkeypatch):
    # Each pair has one word in common, so one to three shingles of a hundred. Before, half of such pairs made groups.
    texts = [" ".join(f"w{k}s{side}x{i}" if i != 50 else f"w{k}" for i in range(100)) for k in range(400) for side in "ab"]
    texts = [t.replace(f"w{k // 2}s{'ab'[k % 2]}x49", f"v{k // 2}").replace(f"w{k // 2}s{'ab'[k % 2]}x51", f"u{k // 2}") for k, t in enumerate(texts)]
    seen, write = {}, jaccard_join.materialize

    def counted(df, name):
        out = write(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in jaccard_join.near_duplicates(rows).collect())
    assert seen["groups"] <= 2 * 400 // 20
