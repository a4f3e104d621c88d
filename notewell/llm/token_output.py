"""Token ids as ORC files: integer run-length encoded stripes, row indexes, Bloom filters on doc_id.

Documents are dealt out by ranges of doc_id, so each file holds one range in ascending order and a file's number orders
the files. Each row has `file` (that number), `pos` (row within the file), `doc_id`, `n_tokens` and `ids`. Readers can
take any stripe alone, skip row groups by the index on doc_id, and skip stripes by its Bloom filter.

Texts are cut at ASCII blanks, and distinct words where the tokenizer itself cuts them; each distinct piece is encoded by
the tokenizer, once per worker or again after its table is full, and a text's ids are those of its pieces. That is only done for a tokenizer whose own file shows that words are independent (see
`words_are_independent`); for any other one the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_words, materialize, once_run, release_memory, scratch_path, slices, trimmed, worker_table

END_ID = 1
MAX_WORDS = 400_000  # distinct words that a worker keeps
BATCH_BYTES = 4 << 20
FILE_BYTES = 128 << 20  # of the optimizer's size of the texts, for each file
MOST_FILES = 100_000  # whatever that estimate says
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.dictionary.key.threshold": "0",
}
_FILE_SCHEMA = "file int, pos long, doc_id long, n_tokens long, ids array<int>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The only word-cutting rule and normalizers under which a text's ids are those of its words one by one.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]


def words_are_independent(path: str) -> bool:
    """Whether the tokenizer's file says that it drops white space and that no rule looks across it.

    Blanks are dropped by the one cut rule, no added token holds a blank or strips one, normalizers work on characters
    that never combine across a blank, and there is no post-processing.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cuts = [
        {"type": "Split", "pattern": {"Regex": _CUTS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    added = spec.get("added_tokens") or []
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == cuts
        and spec["model"]["type"] == "BPE"
        and spec["model"].get("end_of_word_suffix") == _WORD_END
        and not spec["model"].get("dropout")
        and not any(spec.get(x) for x in ("post_processor", "truncation", "padding"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
    )


# The same rule for lower-case ASCII and Latin-1 letters alone, on UTF-8 bytes. Words with other letters, combining marks,
# the signs \u00d7 and \u00f7 or special tokens are left to the tokenizer as they are.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xbf\xc3]+|[0-9]|[^a-z0-9 \t\n\r\x0b\x0c\xc3\x80-\xbf]+")
_PLAIN_BYTES = bytes([*range(0xC0), 0xC3])


def _plain(text: bytes) -> bool:
    odd = text.translate(None, _PLAIN_BYTES) or b"\xc3\x97" in text or b"\xc3\xb7" in text or b"<|" in text
    return not odd


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Table:
    """Arrays of ids by number, one after the other."""

    def __init__(self) -> None:
        self.flat, self.ends, self.n, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used, self.n = self.used + len(ids), self.n + len(lengths)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries, one after the other, and their lengths."""
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        where = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.flat[where], lengths


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] values, the next counts[1] and so on."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


class TextEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, words and their pieces through tables of known ones."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.by_word = words_are_independent(path)
        if self.by_word:  # for pieces that are composed and cut already: the same model, not a copy of it, cutting at blanks
            from tokenizers import normalizers, pre_tokenizers

            self.cut_before = Tokenizer(self.tokenizer.model)
            self.cut_before.normalizer = normalizers.Lowercase()
            cuts = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            self.cut_before.pre_tokenizer = pre_tokenizers.Sequence(cuts)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._reset()
        release_memory()  # what reading the file took

    def _reset(self) -> None:
        self.words, self.pieces = _Numbers(), _Numbers()
        self.word_ids, self.piece_ids = _Table(), _Table()

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [e.ids for e in found]

    def _add_pieces(self, pieces: list[bytes]) -> None:
        """Ids of plain pieces all together, if the tokenizer's word ends are as many, else of each one."""
        joined = b" ".join(pieces)
        if _plain(joined):
            ids = np.array(self.cut_before.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(pieces):
                self.piece_ids.add(ids, np.diff(ends, prepend=0))
                return
        if len(pieces) > 64:
            for k in range(0, len(pieces), 64):
                self._add_pieces(pieces[k : k + 64])
            return
        got = self._ids(pieces)
        self.piece_ids.add(np.array([i for ids in got for i in ids], np.int32), np.array([len(ids) for ids in got]))

    def _learn(self) -> None:
        """Ids of the words and pieces that have a number and no ids yet."""
        words, self.words.new = self.words.new, []
        split: list[list[bytes]] = []
        for k in range(0, len(words), 64):
            some = words[k : k + 64]
            if _plain(b" ".join(some)):
                split += [_PIECES.findall(w.lower()) for w in some]
            else:
                split += [_PIECES.findall(w.lower()) if _plain(w) else [w] for w in some]
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64)
        pieces, self.pieces.new = self.pieces.new, []
        for k in range(0, len(pieces), 2048):
            self._add_pieces(pieces[k : k + 2048])
        ids, lengths = self.piece_ids.take(at)
        self.word_ids.add(ids, _sums(lengths, np.fromiter(map(len, split), np.int64, len(split))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by END_ID, and each text's number of ids. Null is empty."""
        return self._encode_words(texts) if self.by_word else self._encode_whole(texts)

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self._ids([t or b"" for t in texts.cast(pa.binary()).to_pylist()])
        return np.fromiter((i for t in got for i in (*t, END_ID)), np.int32), np.array([len(t) + 1 for t in got], np.int64)

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = ascii_words(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.words) > self.max_words:
            self._reset()
        of = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        ids, lengths = self.word_ids.take(of[words.indices.to_numpy(zero_copy_only=False)])
        per_text = _sums(lengths, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return np.insert(ids, np.cumsum(per_text), END_ID).astype(np.int32, copy=False), per_text + 1


def _encode_batches(path: str, max_words: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_table(("tokens", path, max_words), lambda: TextEncoder(path, max_words))
        file, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1, batch_bytes):
                n = part.num_rows
                ids, counts = encoder.encode(part.column(1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, file, np.int32)),
                        pa.array(np.arange(pos, pos + n)),
                        part.column(0),
                        pa.array(counts),
                        pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    ],
                    names=["file", "pos", "doc_id", "n_tokens", "ids"],
                )
                pos += n

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, files: int | None = None, max_words: int = MAX_WORDS, batch_bytes: int = BATCH_BYTES) -> str:
    """Encodes doc_id and text into ORC files under path, in ascending doc_id order (null ids first).

    A null text is empty: its only id is END_ID. Rows that repeat an id stand side by side, in the order of a hash of
    their texts, and may take several files; equal rows are in one file. A text of any length is one row. Other columns are not read. Without `files` there is one
    for each FILE_BYTES of text, at least as many as the session has shuffle partitions. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("_tie"))
    if not files:
        size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), MOST_FILES))
    ordered = rows.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    tokens = ordered.drop("_tie").mapInArrow(trimmed(_encode_batches(tokenizer or tokenizer_path(), max_words, batch_bytes)), _FILE_SCHEMA)
    with once_run(spark):
        tokens.write.mode("overwrite").options(**ORC_OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as they are; filters on doc_id prune row groups and stripes."""
    return spark.read.schema(_FILE_SCHEMA).option("mergeSchema", "false").orc(path)


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, offsets = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
        n = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), n, pa.array(crc, pa.int64())],
            names=["file", "pos", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are summed first; within a file rows are summed in file order. Both need a few numbers per document only.
    """
    found = read_tokens(spark, path).select("file", "pos", "doc_id", "ids")
    rows = materialize(
        found.mapInArrow(_check_batches, "file int, pos long, doc_id long, n_tokens long, ids_crc32 long"), "token-index"
    )
    earlier = W.partitionBy(F.lit(0)).orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    files = files.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # One row per file, and no more files than tasks of one stage: a bounded table.
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(F.broadcast(files), "file")
        .select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_table(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, max_words: int = MAX_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Writes the files, then answers from them; see token_index. Without a path they stand in a scratch folder. max_words
    and batch_bytes (of texts encoded together) bound the memory of a worker, not the texts."""
    spark = docs.sparkSession
    return token_index(spark, write_tokens(docs, path or scratch_path(spark, "tokens"), tokenizer, max_words=max_words, batch_bytes=batch_bytes))
