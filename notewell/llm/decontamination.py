"""Benchmark decontamination by the q-gram lemma.

Texts are compared as UTF-8 bytes, in lower case and with white space collapsed. A benchmark item (or each overlapping
window of a long one) of m bytes that occurs in a text with at most e edits shares at least m + 1 - q * (e + 1) of its
q-grams with one region of the text, on diagonals at most e apart. So all shared q-grams are counted in overlapping
bands of diagonals, bands that reach the bound are regions, and a banded alignment of the item with each region decides.
q is the largest of a few sizes for which the bound is at least 1, so the lemma holds for every length.

The benchmark is broadcast in blocks of a bounded number of bytes; texts are taken in overlapping pieces, and the places
that share q-grams are counted in bounded portions, however often a q-gram occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, slices, trimmed

SIZES = (12, 8)  # q-grams; the first that fits an item's length and budget
EDIT_RATE = 0.06
WORDS_BELOW = 8  # bytes: shorter items are looked for as whole words between blanks
WINDOW = 200
BLOCK_BYTES = 4 << 20  # of benchmark text in one pass
PIECE = 1 << 17  # bytes of text in one numpy pass
HITS = 1 << 18  # shared q-grams counted together
_TABLE_BITS = 22
LEAK = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def normalize(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for the q-gram at each position, q from 8 to 16."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view("<u8")[:, 0]
    return (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))


def budget_of(length: int) -> int:
    """Edits that an item of so many bytes may have."""
    return int(EDIT_RATE * length)


def gram_size(length: int) -> int:
    return next(q for q in SIZES if length + 1 - q * (budget_of(length) + 1) >= 1)


def windows(length: int) -> list[tuple[int, int]]:
    """A short item whole; a long one as windows that overlap by half."""
    if length <= WINDOW * 3 // 2:
        return [(0, length)]
    starts = [*range(0, length - WINDOW, WINDOW // 2), length - WINDOW]
    return [(s, s + WINDOW) for s in starts]


@dataclass
class Patterns:
    """Windows of benchmark items of one q-gram size, and where each of their q-grams occurs."""

    q: int
    item: np.ndarray
    text: np.ndarray  # windows x bytes, padded
    length: np.ndarray
    budget: np.ndarray
    least: np.ndarray  # shared q-grams that a region needs
    gram: np.ndarray  # sorted, distinct
    first: np.ndarray  # postings of gram i: first[i] to first[i + 1]
    where: np.ndarray  # window of each posting
    position: np.ndarray
    table: np.ndarray  # which hashed values occur at all
    band: int

    @classmethod
    def build(cls, q: int, parts: list[tuple[int, bytes]]) -> Patterns:
        length = np.array([len(b) for _, b in parts], np.int64)
        budget = np.array([budget_of(n) for n in length], np.int64)
        text = np.zeros((len(parts), int(length.max(initial=1))), np.uint8)
        all_grams, where, position = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, (_, b) in enumerate(parts):
            text[i, : len(b)] = np.frombuffer(b, np.uint8)
            g = grams(text[i, : len(b)], q)
            all_grams.append(g)
            where.append(np.full(len(g), i, np.int32))
            position.append(np.arange(len(g), dtype=np.int32))
        g = np.concatenate(all_grams)
        order = np.argsort(g, kind="stable")
        gram, first = np.unique(g[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[gram >> np.uint64(64 - _TABLE_BITS)] = True
        item = np.array([i for i, _ in parts], np.int64)
        least = length + 1 - q * (budget + 1)
        return cls(q, item, text, length, budget, least, gram, np.append(first, len(g)), np.concatenate(where)[order], np.concatenate(position)[order], table, int(budget.max(initial=0)) + 1)

    @property
    def reach(self) -> int:
        """Bytes of text that one occurrence and its band can take."""
        return self.text.shape[1] + 2 * self.band + self.q

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of a band) wherever a band of text holds enough q-grams of a window."""
        found = [(w, d + start) for start, piece in _pieces(text, PIECE, self.reach) for w, d in self._regions(piece)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window, diagonal = map(np.concatenate, zip(*found))
        both = np.unique(np.stack([window, diagonal]), axis=1)
        return both[0], both[1]

    def _regions(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        g = grams(text, self.q)
        at = np.flatnonzero(self.table[g >> np.uint64(64 - _TABLE_BITS)])
        found = np.searchsorted(self.gram, g[at])
        real = (found < len(self.gram)) & (self.gram[np.minimum(found, len(self.gram) - 1)] == g[at])
        at, found = at[real], found[real]
        n = self.first[found + 1] - self.first[found]
        total = int(n.sum())
        if not total:
            return
        if total > HITS and len(text) > 4 * self.reach:
            for start, piece in _pieces(text, len(text) // 2, self.reach):
                for w, d in self._regions(piece):
                    yield w, d + start
            return
        shift = len(self.text[0]) + self.band
        bands = (len(text) + shift) // self.band + 2
        ends = np.cumsum(n)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, total, HITS):  # portions of the hits, in the order of the text
            hit = np.arange(low, min(low + HITS, total))
            owner = np.searchsorted(ends, hit, side="right")
            post = self.first[found[owner]] + hit - (ends[owner] - n[owner])
            diagonal = at[owner] - self.position[post] + shift
            key = self.where[post] * np.int64(bands) + diagonal // self.band
            some, c = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
        window = keys // bands
        good = counts >= self.least[window]
        yield window[good], (keys[good] % bands) * self.band - shift

    def align(self, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window within its band of 2 * band diagonals, with free ends in the text, and the end."""
        width, rows = 2 * self.band, self.text.shape[1]
        padded = np.concatenate([np.zeros(rows + width, np.uint8), text, np.zeros(2 * rows + 2 * width, np.uint8)])
        base = diagonal + rows + width
        slope = np.arange(width)
        cost = np.zeros((len(window), width), np.int32)
        edits, end = np.full(len(window), 1 << 30), np.zeros(len(window), np.int64)
        big = np.full((len(window), 1), 1 << 20, np.int32)
        for i in range(rows):
            done = np.flatnonzero(self.length[window] == i)
            if len(done):
                edits[done], end[done] = cost[done].min(1), diagonal[done] + i + cost[done].argmin(1)
            step = cost + (padded[(base + i)[:, None] + slope] != self.text[window, i][:, None])
            step = np.minimum(step, np.hstack([cost[:, 1:], big]) + 1)
            cost = (np.minimum.accumulate(step - slope, axis=1) + slope).astype(np.int32)
        done = np.flatnonzero(self.length[window] == rows)
        edits[done], end[done] = cost[done].min(1), diagonal[done] + rows + cost[done].argmin(1)
        return edits, end

    def start_of(self, text: np.ndarray, window: int, end: int, edits: int) -> int:
        """Where the occurrence that ends at `end` with so many edits begins: by the same alignment backwards."""
        m = int(self.length[window])
        if not edits:
            return end - m
        item = self.text[window, :m][::-1]
        back = text[max(0, end - m - edits) : end][::-1]
        slope = np.arange(len(back) + 1)
        cost = slope.copy()
        for i in range(m):
            step = np.minimum(np.append(i + 1, cost[:-1] + (back != item[i])), np.append(i + 1, cost[1:] + 1))
            cost = np.minimum.accumulate(step - slope) + slope
        fits = np.flatnonzero(cost == cost.min())
        return end - int(fits[np.argmin(np.abs(fits - m))])


def _pieces(text: np.ndarray, size: int, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of text that overlap so far that every stretch of `reach` bytes lies in one, and where they start."""
    step = max(size, reach)
    for start in range(0, max(1, len(text) - reach), step):
        yield start, text[start : start + step + reach]


@dataclass
class Benchmark:
    """Benchmark items, by the way in which they are looked for."""

    patterns: list[Patterns]
    phrases: dict[bytes, list[int]]  # items under WORDS_BELOW bytes
    words: list[int]  # numbers of words of such items

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Benchmark:
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        phrases: dict[bytes, list[int]] = {}
        for item, text in items:
            b = normalize(text)
            if len(b) >= WORDS_BELOW:
                for s, e in windows(len(b)):
                    by_size.setdefault(gram_size(e - s), []).append((item, b[s:e]))
            elif b:
                phrases.setdefault(b, []).append(item)
        return cls([Patterns.build(q, parts) for q, parts in sorted(by_size.items())], phrases, sorted({p.count(b" ") + 1 for p in phrases}))

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text, the best place of every item that it holds within the budget."""
        out: list[list[dict]] = [[] for _ in texts]
        held, size, first = [], 0, 0
        for i, t in enumerate(texts):
            held.append(normalize(t))
            size += len(held[-1])
            if size >= PIECE or i == len(texts) - 1:
                for j, found in self._leaks(held):
                    out[first + j] = found
                held, size, first = [], 0, i + 1
        return out

    def _leaks(self, texts: list[bytes]) -> Iterator[tuple[int, list[dict]]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}  # (text, item): edits, start, end

        def keep(j: int, item: int, edits: int, start: int, end: int) -> None:
            best[j, item] = min(best.get((j, item), (edits, start, end)), (edits, start, end))

        for patterns in self.patterns:
            gap = b"\0" * patterns.reach  # no alignment reaches another text
            text = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
            lengths = np.array([len(t) for t in texts]) + len(gap)
            starts = np.cumsum(lengths) - lengths + len(gap)
            window, diagonal = patterns.regions(text)
            for a in range(0, len(window), 4096):
                w, d = window[a : a + 4096], diagonal[a : a + 4096]
                edits, end = patterns.align(text, w, d)
                owner = np.clip(np.searchsorted(starts, end, side="left") - 1, 0, None)  # an occurrence ends within its text
                for k in np.flatnonzero(edits <= patterns.budget[w]):
                    j, item, e, stop = int(owner[k]), int(patterns.item[w[k]]), int(edits[k]), int(end[k])
                    if best.get((j, item), (1 << 30,))[0] >= e:
                        begin = max(int(starts[j]), patterns.start_of(text, w[k], stop, e))
                        keep(j, item, e, begin - int(starts[j]), stop - int(starts[j]))
        for j, text in enumerate(texts) if self.phrases else ():
            words = text.split(b" ")
            ends = np.cumsum([len(x) + 1 for x in words])
            for n in self.words:
                for i in range(len(words) - n + 1):
                    for item in self.phrases.get(b" ".join(words[i : i + n]), ()):
                        keep(j, item, 0, int(ends[i]) - len(words[i]) - 1, int(ends[i + n - 1]) - 1)
        by_text: dict[int, list[dict]] = {}
        for (j, item), (edits, start, end) in sorted(best.items()):
            by_text.setdefault(j, []).append({"item_id": item, "edits": edits, "start": start, "end": end})
        yield from by_text.items()


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(shared: Broadcast, at: int):
    """The batches with a column `leaks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 4 * PIECE, 1000):
                found = shared.value.leaks(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _LEAKS)], names=[*part.schema.names, "leaks"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs and `leaks`, an array of (item_id, edits, start, end), empty for a clean text.

    docs needs `text`; benchmark needs item_id and text. An item of m bytes may have 6 % of m edits, rounded down; items
    under WORDS_BELOW bytes count where they stand as whole words. start and end are byte offsets in the normalised text:
    of the whole item, or of the window of a longer item (over 300 bytes) that fits best. The first of equally good
    places counts. Null and empty texts are clean, null and blank items are not looked for; items that share an id are
    one item, of which the best place counts. Texts of any length are searched whole; an empty table on either side
    gives no leaks. A column `leaks` of docs is replaced, other columns stay as they are.

    A benchmark of several blocks takes one pass over the texts for each; then only a row number and the text pass
    through Python.
    """
    spark = docs.sparkSession
    rows = docs.drop("leaks")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))

    def block(b: int) -> Broadcast:
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Benchmark.build(sorted((r["item_id"], r["text"]) for r in some.collect())))  # about block_bytes

    if blocks == 1:
        schema = T.StructType([*rows.schema.fields, T.StructField("leaks", T.ArrayType(LEAK))])
        return rows.mapInArrow(trimmed(_found(block(0), rows.columns.index("text"))), schema)
    number = next(name for i in range(len(rows.columns) + 1) if (name := f"_row{i}") not in rows.columns)
    rows = materialize(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    schema = T.StructType([T.StructField(number, T.LongType()), T.StructField("text", rows.schema["text"].dataType), T.StructField("leaks", T.ArrayType(LEAK))])
    found = [
        materialize(rows.select(number, "text").mapInArrow(trimmed(_found(block(b), 1)), schema).filter(F.size("leaks") > 0).select(number, "leaks"), "leaks")
        for b in range(blocks)
    ]
    every = reduce(DataFrame.union, found).groupBy(number).agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    empty = F.array().cast(T.ArrayType(LEAK))
    return rows.join(every, number, "left").withColumn("leaks", F.coalesce(F.sort_array("leaks"), empty)).drop(number)
