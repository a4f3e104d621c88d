"""Set-similarity join on word n-grams: prefixes of token combinations, then exact verification.

A document's set is that of its distinct word shingles (64-bit hashes). All sets are ordered alike: rare shingles first,
frequent ones last, by hash within a class. Two sets of Jaccard similarity t share at least 1 + c tokens within their
prefixes of n - ceil(t * n) + 1 + c tokens. So, with the frequent tokens dealt into c classes, a pair shares a rare
token of both prefixes (already of those without c), or two frequent tokens of one class. Rare tokens are indexed alone, frequent ones as pairs
within their class; c grows with the set's size, so that a document never makes more than some pairs for each token.
Sets of like size (within t) fall into the same or neighbouring size bands, which fixes c for every pair; every key of
the index holds its band. A set meets larger ones of the next band there with a shorter prefix, since such a pair has to
share more.

Which tokens are frequent is counted over the prefixes of all documents, and again for the tokens that move up when the
frequent ones are set back. The answer is kept in a bit table; a wrong bit moves a token to the other end of the order
for every document alike, which costs time and loses nothing.

No pair is listed under a key. The least member of a key is its hub, and all members of a hub's keys form its group, one
narrow row for each. A group is split into cells of bounded size, two cells meet in one unit of work, and there parity
sketches of the sets decide which pairs of different components are likely links. A unit names only pairs that connect
what is not yet connected, so its output is no longer than its input. Those pairs are verified exactly, links join
components, and groups that had likely pairs and still hold several components are gone through again; the last pass
names every likely pair left. So the components are those of all links, equal sets are one node, and links within a component are not listed.
Near copies that are many, pairwise unlinked and close to the bound are compared pair by pair in their units' memory:
that part of the work has no bound below the square of such a group, it is dealt out over cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ascii_words, drop_scratch, materialize, release_memory, slices, trimmed

FREQUENT = 16  # prefixes that a token is in, above which it is of a frequent class
LEAST_BITS, MOST_BITS = 22, 28  # a bit table has 2**22 bits, or about 12 for each value, up to 2**28
SKETCH_BITS = 1  # of the parity sketch for each shingle, rounded up to a power of two, 512 in all at least
ROUNDS = 1  # in which tokens that move up are counted too
CLASS_SIZE = 2  # missing tokens for each class: about 2.25 pairs for each, where 8 make 5
SLICE_BYTES = 1 << 20  # of text, or of sets, in one step of a task
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def shingle_sets(texts: pa.Array, n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z in lower case, words between ASCII blanks."""
    lists = ascii_words(texts)
    words = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w.lower()) for w in words.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    real = np.array(pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0, bool)
    at = words.indices.to_numpy(zero_copy_only=False)
    per_text = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), per_text)
    some = real[at] if len(at) else np.zeros(0, bool)
    at, owner = at[some], owner[some]
    h = hashes[at] if len(at) else np.zeros(0, np.uint64)
    n_of = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(n_of)
    size = np.minimum(n_words, n_of)  # words of a shingle: all words of a shorter text
    s = np.repeat(size.astype(np.uint64), n_of) * _K[4]
    for k in range(n_words):
        # Within a shorter text only its first position counts, and that one stops at its last word.
        shifted = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)]) * _K[k % 3]
        mixed = _rot(s ^ shifted, 23) * _K[3]
        s = mixed if (n_of > k).all() else np.where(np.repeat(size, n_of) > k, mixed, s)
    s = (s ^ (s >> np.uint64(33))) * _K[4]
    s ^= s >> np.uint64(29)
    return [np.unique(s[e - n : e - z + 1]) if n else s[:0] for e, n, z in zip(ends, n_of, size)]


class Bounds:
    """Sizes and prefix lengths for links of 100 * intersection >= percent * union."""

    def __init__(self, percent: int, largest: int = 1 << 28):
        self.percent = percent
        edges = [1]
        while edges[-1] < largest:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def classes(self, band: int) -> int:
        slack = int(self.edges[band]) * (100 - self.percent) // 100
        return max(1, slack // CLASS_SIZE)

    def prefix(self, n: int, classes: int) -> int:
        return min(n, n - -(-self.percent * n // 100) + 1 + classes)

    def upper_prefix(self, n: int, band: int, classes: int) -> int:
        """Of a set of this band, for links with sets of the next one, which are larger; 0 if none can be a link."""
        short = n - -(-self.percent * (n + int(self.edges[band + 1])) // (100 + self.percent)) + 1
        return min(n, short + classes) if short > 0 else 0

    def alone(self, n: int) -> bool:
        """A set so small that only equal ones can link with it."""
        return 100 * n < self.percent * (n + 1)

    def most(self, total: np.ndarray) -> np.ndarray:
        """Shingles in one set only that two linked sets of `total` shingles together may have."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))


def bit_table(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits, packed, with those of the values set; at most 2**bits / 64 rows reach the driver."""
    at = F.pmod(F.col(column), F.lit(1 << bits))
    words = values.select(F.shiftrightunsigned(at, 6).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("s"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("v")).toArrow()
    table = np.zeros((1 << bits) // 64, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    del words
    release_memory()
    return table.view(np.uint8)


BANDS = 62  # band numbers are told apart up to this many
BAND_SALTS = np.array([k * int(_K[2]) % 2**64 for k in range(BANDS)], np.uint64)


def in_bands(counts: DataFrame) -> DataFrame:
    """tok mixed with each band in which it can join two sets: counts has tok, and bit_or and bit_and of its bands.

    If all sets of a token have a band in common, that band joins every two of them.
    """
    live = F.when(F.col("common") != 0, F.col("common").bitwiseAND(-F.col("common"))).otherwise(F.col("bands"))
    salts = F.array(*[F.lit(int(x)) for x in BAND_SALTS.view(np.int64)])
    bands = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.getbit(F.col("live"), b) == 1)
    each = counts.select("tok", live.alias("live")).select("tok", F.explode(bands).alias("b"))
    return each.select(F.col("tok").bitwiseXOR(F.element_at(salts, F.col("b") + 1)).alias("tok"))


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))


def has(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(8 * len(table) - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens in the common order, and how many are rare."""
    f = has(frequent, tokens)
    return np.concatenate([tokens[~f], tokens[f]]), int((~f).sum())


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes by their last bits: where two sketches differ, the sets differ."""
    m = max(512, 1 << int(SKETCH_BITS * len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & np.uint64(m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()


def expected(difference: np.ndarray | int, bits: int) -> np.ndarray | float:
    """Bits in which sketches differ on average, if the sets differ by so many shingles."""
    return bits / 2 * (1 - np.exp(-2 * difference / bits))


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half the length, for a set or for each row of many."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                sets = shingle_sets(part.column(2), n_words)
                node, toks = [], []
                for s in sets:
                    raw = s.tobytes()
                    d = int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64)) if len(s) else None
                    first = d is not None and d not in seen
                    node.append(d)
                    toks.append(raw if first else None)
                    if first:
                        seen.add(d)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(toks, pa.binary())],
                    names=["doc_id", "text_key", "n", "node", "toks"],
                )

    return run


def _tokens(batch: pa.RecordBatch, at: int) -> Iterator[np.ndarray]:
    for raw in batch.column(at).to_pylist():
        yield np.frombuffer(raw, np.uint64)


COUNTED = 40  # bits by which tokens are told apart while they are counted; more than a bit table tells apart


def _prefix_tokens(bounds: Bounds, frequent: Broadcast | None = None):
    """Tokens of the prefixes, by 32 bits; given the frequent ones, those that moved there because of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 * SLICE_BYTES):
                out = [np.zeros(0, np.uint64)]
                for s in _tokens(part, 0):
                    q = bounds.prefix(len(s), 0)
                    found = s[:q]
                    if frequent is not None:
                        if not has(frequent.value, found).any():
                            continue
                        order, rare = ordered(s, frequent.value)
                        now = order[: min(q, rare)]
                        found = now[~np.isin(now, found, assume_unique=True)]
                    out.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.uint32).view(np.int32))], names=["tok"])

    return run


def _rare_tokens(bounds: Bounds, frequent: Broadcast):
    """Rare tokens of the prefixes by COUNTED bits, and the bands they take part in, as bits."""
    low = np.uint64((1 << COUNTED) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 * SLICE_BYTES):
                out, bands = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in _tokens(part, 0):
                    n, band = len(s), bounds.band(len(s))
                    order, rare = ordered(s, frequent.value)
                    found = order[: min(bounds.prefix(n, 0), rare)]
                    in_band = np.full(len(found), 1 << band % BANDS)
                    in_band[: bounds.upper_prefix(n, band, 0)] |= 1 << (band + 1) % BANDS
                    out.append(found & low)
                    bands.append(in_band)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(bands))], names=["tok", "bands"])

    return run


def _postings(bounds: Bounds, frequent: Broadcast, shared: Broadcast):
    """key, node, n and most: rare tokens alone, pairs of frequent ones of a class, each in both bands of the set. A link
    that has no earlier key in common shares `most` tokens at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES, 500):
                keys: list[np.ndarray] = []
                most: list[np.ndarray] = []
                counts = np.zeros(part.num_rows, np.int64)
                sizes = np.zeros(part.num_rows, np.int32)
                for row, s in enumerate(_tokens(part, 0)):
                    n = sizes[row] = len(s)
                    order, rare = ordered(s, frequent.value)
                    own = bounds.band(n)
                    alone, upper = bounds.prefix(n, 0), bounds.upper_prefix(n, own, 0)
                    # A link shares a token of both prefixes without the extension. If none such is rare, all rare
                    # tokens of both sets are in those prefixes, so the extended ones share frequent tokens only.
                    for band, q in ((own, alone), (own + 1, upper)):
                        classes = bounds.classes(band)
                        salt = np.uint64((band + 1) * int(_K[2]) % 2**64)
                        known = order[: min(q, rare)]
                        at = np.flatnonzero(has(shared.value, known ^ BAND_SALTS[band % BANDS]))
                        found, left = [_rot(known[at] ^ salt, 29) * _K[0]], [n - at]
                        tail = order[rare : min(n, q + classes)] if rare < q else order[:0]
                        if len(tail) > 1:
                            kind = (tail >> np.uint64(40)) % np.uint64(classes)
                            by = np.argsort(kind, kind="stable")
                            for group in np.split(by, np.flatnonzero(np.diff(kind[by])) + 1):
                                if len(group) > 1:
                                    i, j = np.triu_indices(len(group), 1)
                                    found.append(_rot(tail[group[i]] * _K[0] ^ _rot(tail[group[j]] * _K[1], 31) ^ salt, 17) * _K[3])
                                    left.append(n - rare - group[j] + classes)  # the later one is the (classes + 1)th they share at most
                        keys += found
                        most += left
                        counts[row] += sum(map(len, found))
                key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                node = np.repeat(part.column(1).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(node), pa.array(np.repeat(sizes, counts)), pa.array(np.concatenate([*most, sizes[:0]]).astype(np.int32))],
                    names=["key", "node", "n", "most"],
                )

    return run


def _sketches(wanted: Broadcast):
    """node, n and sketch of the sets whose node is in the bit table, and where the set is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 * SLICE_BYTES):
                part = part.filter(pa.array(has(wanted.value, part.column(1).to_numpy().view(np.uint64))))
                sets = list(_tokens(part, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([_sketch(s) for s in sets], pa.binary()), part.column(2), part.column(3)],
                    names=["node", "n", "sketch", "doc_id", "text_key"],
                )

    return run


CELL_ROWS, CELL_BYTES = 2000, 4 << 20  # of a cell of a group, about
SMALL = 24  # members of a unit up to which it is compared pair by pair


class _Unit:
    """Members of one unit of work, in the order in which they came: hub, lo, hi, own cell, node, label, n, sketch."""

    def __init__(self, rows: list[tuple], bounds: Bounds, step: int):
        self.rows, self.bounds = sorted(rows, key=lambda r: (r[6], r[4])), bounds
        self.rng = np.random.default_rng(step)  # each pass names other pairs
        self.open = False  # whether any pair of different labels may be a link
        self.cross = rows[0][1] != rows[0][2]

    def likely(self, every: bool) -> list[tuple[int, int]]:
        """Pairs (node, node of the smaller set) of different labels whose sketches leave room for a link. Unless every
        pair is asked for, only those that are about as near as a link has to be, and connect members which earlier ones
        do not."""
        return self._one_by_one(every) if len(self.rows) <= SMALL else self._in_blocks(every)

    def _one_by_one(self, every: bool) -> list[tuple[int, int]]:
        rows, percent = self.rows, self.bounds.percent
        out, comp = [], [r[5] for r in rows]
        bits = [int.from_bytes(r[7], "little") for r in rows]
        width = [8 * len(r[7]) for r in rows]
        for i, a in enumerate(rows):
            for j in self.rng.permutation(np.arange(i + 1, len(rows))).tolist() if len(rows) > 2 else range(i + 1, len(rows)):
                b = rows[j]
                if 100 * a[6] < percent * b[6]:
                    continue
                if (comp[i] == comp[j] and self.open if not every else a[5] == b[5]) or (self.cross and a[3] == b[3]):
                    continue
                x, y = bits[i], bits[j]
                for w in range(width[j].bit_length() - 1, width[i].bit_length() - 1, -1):
                    half = 1 << (w - 1)
                    y = (y & ((1 << half) - 1)) ^ (y >> half)
                total = a[6] + b[6]
                most = total - 2 * -(-percent * total // (100 + percent))
                d = (x ^ y).bit_count()
                self.open |= d <= most and a[5] != b[5]
                if d <= (most if every else expected(most, width[i])):
                    if not every and comp[i] == comp[j]:
                        continue
                    out.append((b[4], a[4]))
                    old, new = comp[j], comp[i]
                    comp = [new if c == old else c for c in comp]
        return out

    def _in_blocks(self, every: bool) -> list[tuple[int, int]]:
        rows = self.rows
        n, side, label = (np.array([r[k] for r in rows], np.int64) for k in (6, 3, 5))
        length = np.array([len(r[7]) for r in rows])
        comp = np.unique(label, return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        # A sketch is at most twice as long as that of a set it can link with, for sizes within a half.
        for size in np.unique(length):
            own, double = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
            m = np.frombuffer(b"".join(rows[i][7] for i in own), np.uint64).reshape(len(own), -1)
            wide = np.frombuffer(b"".join(rows[i][7] for i in double), np.uint64).reshape(len(double), 2 * m.shape[1])
            other = np.concatenate([own, double])
            all_bits = np.ascontiguousarray(np.concatenate([m, folded(wide)] if len(double) else [m]).T)
            step = max(1, min(64, (1 << 18) // len(other)))
            for start in range(0, len(own), step):
                mine = own[start : start + step]
                stop = int(np.searchsorted(n[other], n[mine[-1]] * 100 // self.bounds.percent, side="right"))
                there = other[start + 1 : stop]
                if not len(there):
                    continue
                d = np.zeros((len(mine), len(there)), np.int32)
                for w in range(len(all_bits)):
                    d += np.bitwise_count(m[start : start + step, w, None] ^ all_bits[None, w, start + 1 : stop])
                most = self.bounds.most(n[mine, None] + n[None, there])
                fine = (d <= most) & (100 * n[mine, None] >= self.bounds.percent * n[None, there])
                fine &= (label[mine, None] != label[None, there]) & (mine[:, None] < there[None])
                if self.cross:
                    fine &= side[mine, None] != side[None, there]
                if not every:
                    self.open = self.open or bool(fine.any())
                    fine &= d <= expected(most, 8 * size)
                for k in np.flatnonzero(fine.any(1)):
                    i, js = mine[k], there[fine[k]]
                    if not every:
                        js = self.rng.permutation(js[comp[js] != comp[i]])
                        joined, first = np.unique(comp[js], return_index=True)
                        js = js[first]
                        comp[np.isin(comp, joined)] = comp[i]
                    out += [(rows[j][4], rows[i][4]) for j in js]
        return out


def _likely(bounds: Bounds, step: int):
    """Rows in the order of hub, lo and hi: the likely pairs of each unit, and its hub. A unit that names no pair now and
    may name some in the last pass gives its hub alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, out = None, [], []

        def named(unit: tuple | None, rows: list[tuple]) -> list[tuple]:
            if len(rows) < 2:
                return []
            work = _Unit(rows, bounds, step)
            pairs = [(*pair, unit[0]) for pair in work.likely(step == PASSES)]
            return pairs or ([(None, None, unit[0])] if work.open else [])

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "hub"])

        for batch in batches:
            for part in slices(batch, 7, 4 * SLICE_BYTES):
                for row in zip(*(part.column(i).to_pylist() for i in range(8))):
                    if row[:3] != unit:
                        out += named(unit, rows)
                        unit, rows = row[:3], []
                        if len(out) > 100_000:
                            yield batch_of()
                            out = []
                    rows.append(row)
        out += named(unit, rows)
        yield batch_of()

    return run


MEMBERS = 500  # sets that are compared with one copy of a hub's set
BROADCAST_ROWS = 200_000  # rows of four longs


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of hub and part, the hub's own set first in each: sizes and intersection of hub and member."""
    part, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for piece in slices(batch, 3, 4 * SLICE_BYTES):
            columns = (piece.column(i).to_pylist() for i in range(4))
            for hub, salt, member, toks in zip(*columns):
                tokens = np.frombuffer(toks, np.uint64)
                if (hub, salt) != part:
                    part, own = (hub, salt), tokens
                elif member != hub:
                    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    out.append((hub, member, len(own), len(tokens), int((own[at] == tokens).sum())))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "both"])


def _wanted_rows(table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(table.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _verified(likely: DataFrame, nodes: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (a, b) that are links by the sets themselves.

    nodes: node, doc_id and text_key of the row that holds the set. sets: node, doc_id, text_key, toks. Each set of a
    pair moves to its hub (b) once; a hub with many members is split into parts, with a copy of its set in each.
    """
    spark = sets.sparkSession
    parts = likely.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_k"))
    members = likely.join(parts, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("_k")).cast("int").alias("salt"))
    hubs = parts.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("salt"))
    at = nodes.select("node", F.col("doc_id").alias("_at"), F.col("text_key").alias("_key"))
    need = materialize(members.union(hubs).join(at, "node").withColumnRenamed("node", "_node"), "moves")
    n = need.count()
    held = sets
    if n > BROADCAST_ROWS:  # few of the sets are needed: only those are shuffled
        wanted = spark.sparkContext.broadcast(bit_table(need, "_node", bits_for(n)))
        held = sets.select("node", "doc_id", "text_key", "toks").mapInArrow(trimmed(_wanted_rows(wanted)), "node long, doc_id long, text_key long, toks binary")
    named = F.broadcast(need) if n <= BROADCAST_ROWS else need
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_at")) & (F.col("text_key") == F.col("_key"))
    shuffled = held.join(named, same).select("hub", "salt", F.col("node").alias("member"), "toks", (F.col("node") != F.col("hub")).alias("_m"))
    placed = shuffled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hub", "salt")
    counted = placed.sortWithinPartitions("hub", "salt", "_m").drop("_m").mapInArrow(trimmed(_compare), "a long, b long, n_a long, n_b long, both long")
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    links = materialize(counted.filter(100 * F.col("both") >= bounds.percent * union).select("a", "b").distinct(), "links")
    drop_scratch(need)
    return links


PASSES = 3  # over groups of several components, before the one that names all likely pairs


def link_components(groups: DataFrame, nodes: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame | None:
    """node and label for all nodes that link with another one.

    groups: hub, node, n, the hub among its members. nodes: node, n, sketch, doc_id, text_key.
    """
    spark = groups.sparkSession
    labels: DataFrame | None = None
    hubs: DataFrame | None = None
    live, owned, step = groups, [], 0
    while True:
        if hubs is None:
            named = live.withColumn("label", F.col("node"))
        else:
            some = live.join(hubs, "hub", "left_semi")  # a group without a likely or open pair will not have one later
            if labels is None:
                whole = some.withColumn("label", F.col("node"))
            else:
                whole = some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            named = whole = materialize(whole, "named")
            mixed = named.groupBy("hub").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo != _hi").select("hub")
            named = materialize(named.join(mixed, "hub", "left_semi"), "live")
            drop_scratch(whole, hubs, *owned)
            owned, live = [named], named.drop("label")
        size = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n") / CELL_BYTES)).cast("int")
        cells = named.groupBy("hub").agg(size.alias("_c")).filter("_c > 1")
        celled = named.join(cells, "hub", "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
        celled = celled.withColumn("own", F.pmod(F.xxhash64("node", F.lit(step)), F.col("_c")).cast("int"))
        celled = celled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        units = celled.select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label")
        units = materialize(units, "units")
        few = units.count() <= BROADCAST_ROWS
        sized = nodes.select("node", "n", "sketch").join(F.broadcast(units) if few else units, "node").select("hub", "lo", "hi", "own", "node", "label", "n", "sketch")
        placed = sized.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hub", "lo", "hi")
        found = placed.sortWithinPartitions("hub", "lo", "hi").mapInArrow(trimmed(_likely(bounds, step)), "a long, b long, hub long")
        found = seen = materialize(found, "seen")
        drop_scratch(units)
        found = found.filter("a IS NOT NULL")
        if step < 2:
            # One pair for each node: what the others would link mostly follows.
            found = found.groupBy("a", "b").count().groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        likely = materialize(found.select("a", "b").distinct(), "likely")
        hubs = materialize(seen.select("hub").distinct(), "hubs")
        drop_scratch(seen)
        some_likely = likely.limit(1).count() > 0
        if some_likely:
            links = _verified(likely, nodes, sets, bounds)
            edges = links if labels is None else links.union(labels.select("node", "label"))
            old, labels = labels, components(edges)
            drop_scratch(links, *([old] if old is not None else []))
        drop_scratch(likely)
        # Only the last pass asks for every pair, so it is left out only if no group has an open one.
        if step == PASSES or not (some_likely or hubs.limit(1).count()):
            break
        step = step + 1 if some_likely else PASSES
    drop_scratch(hubs, *owned)
    return labels


def near_duplicate_classes(docs: DataFrame, n_words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key (xxhash64 of the text), n (size of the set), label (null for an empty set).

    Rows of one label are connected by links. The table is materialized.
    """
    spark = docs.sparkSession
    bounds = Bounds(percent)
    typed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    found = materialize(typed.mapInArrow(trimmed(_sets(n_words)), "doc_id long, text_key long, n long, node long, toks binary"), "sets")
    # Sets to index: one copy per task of each that could link with a different one.
    least = next(n for n in range(1, 10_000) if not bounds.alone(n))
    source = found.filter(F.col("toks").isNotNull() & (F.col("n") >= least)).select("toks", "node", "doc_id", "text_key")
    share = lambda x: spark.sparkContext.broadcast(x)

    def often(*what: object) -> DataFrame:
        tokens = source.select("toks").mapInArrow(trimmed(_prefix_tokens(bounds, *what)), "tok int")
        return tokens.groupBy("tok").agg(F.count("*").alias("count")).filter(F.col("count") > FREQUENT).select("tok")

    first = materialize(often(), "prefix")
    bits = bits_for(first.count())
    frequent = bit_table(first, "tok", bits)
    drop_scratch(first)
    for _ in range(ROUNDS if frequent.any() else 0):
        frequent = frequent | bit_table(often(share(frequent)), "tok", bits)
    rare = source.select("toks").mapInArrow(trimmed(_rare_tokens(bounds, share(frequent))), "tok long, bands long")
    # A token whose sets have no band in common leads to no pair.
    counts = rare.groupBy("tok").agg(F.sum(F.bit_count("bands")).alias("_all"), F.bit_or("bands").alias("bands"), F.bit_and("bands").alias("common"))
    counts = materialize(counts.filter("_all > bit_count(bands)").drop("_all"), "prefix")
    shared = bit_table(in_bands(counts), "tok", bits_for(counts.count()))
    drop_scratch(counts)
    keyed = "key long, node long, n int, most int"
    emitted = source.select("toks", "node").mapInArrow(trimmed(_postings(bounds, share(frequent), share(shared))), keyed)
    emitted = materialize(emitted, "postings")
    # Most keys are in one row, so whole rows are shuffled only of keys whose last 32 bits are in several.
    several = materialize(emitted.groupBy(F.pmod("key", F.lit(1 << 32)).alias("key")).count().filter("count > 1").select("key"), "several")
    met = share(bit_table(several, "key", bits_for(several.count())))
    drop_scratch(several)
    rows = materialize(emitted.mapInArrow(trimmed(_wanted_rows(met)), keyed), "met")
    drop_scratch(emitted)
    # Two sets alone under a key have to share as many tokens as a link of their sizes.
    enough = F.col("_most") * (100 + percent) >= percent * F.col("_n")
    sums = [F.count("*").alias("_rows"), F.sum("n").alias("_n"), F.min("most").cast("long").alias("_most")]
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_hi"), *sums)
    hubs = hubs.filter((F.col("hub") != F.col("_hi")) & ((F.col("_rows") > 2) | enough)).select("key", "hub")
    members = rows.join(hubs, "key").select("hub", "node", "n").distinct()  # the hub itself is a member of its keys
    groups = materialize(members, "groups")
    drop_scratch(rows)
    n_rows = groups.count()
    wanted = share(bit_table(groups.select("node").distinct(), "node", bits_for(n_rows)))
    listed = source.mapInArrow(trimmed(_sketches(wanted)), "node long, n int, sketch binary, doc_id long, text_key long")
    where = F.min(F.struct("doc_id", "text_key")).alias("_w")
    nodes = listed.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), where)
    nodes = materialize(nodes.select("node", "n", "sketch", "_w.doc_id", "_w.text_key"), "nodes")
    labels = link_components(groups, nodes, source, bounds)
    rows = found.select("doc_id", "text_key", "n", "node")
    if labels is not None:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        rows = rows.withColumn("label", F.col("node"))
    rows = materialize(rows.select("doc_id", "text_key", "n", "label"), "classes")
    drop_scratch(found, groups, nodes, *([labels] if labels is not None else []))
    return rows


def near_duplicates(docs: DataFrame, n_words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id that links lead to).

    A text of fewer than n_words words is one shingle; a null text and one without words have none and link with
    nothing. Texts of any length are taken whole. Repeated rows link with each other; null ids take part and never name
    a component unless all its ids are null. Other columns of docs are not read. Without rows the result is empty. Sets
    and shingles are told apart by 64-bit hashes.
    """
    rows = near_duplicate_classes(docs, n_words, percent, doc_id, text)
    classes = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("_least"))
    out = rows.join(classes, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))
