"""Alignment of two tokenizers over the same bytes: which runs of A tokens cover the same bytes as which runs of B tokens.

Packed bitsets mark the byte offsets where a token ends, one for each tokenizer; their AND has the shared cuts; popcounts
rank a cut among a tokenizer's token ends, which gives the token ranges between two cuts. A cut links the A token and the
B token that end there. Links are counted over the corpus in a first pass; a second pass gives each text its digest.

Texts are cut before a space or line end that follows a visible character, and each distinct piece is encoded and
aligned once per worker, as the files of both tokenizers show that no token and no rule reaches across such a place (see
`pieces_are_independent`). Other tokenizers get whole texts, as pieces of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, materialize, slices, trimmed, worker_table
from .token_output import _Numbers, _sums, _Table, tokenizer_path

PAIR_BASE = 1 << 32  # a pair's code is A id * PAIR_BASE + B id
MAX_PIECES = 200_000  # distinct pieces that a worker keeps
MAX_PIECE_BYTES = 32 << 20  # and their bytes
BATCH_BYTES = 2 << 20
BROADCAST_PAIRS = 2_000_000  # of 17 bytes each; rarer pairs are joined
SPACE_MARK = "▁"

# The setting of a byte-level tokenizer under which no token holds a blank behind a visible character.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# Cuts lie before a space or line end behind a visible character; blanks at the end of a text are a piece or a part of one.
_PIECES = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+\Z")
_PLAIN_PIECES = re.compile(r"[ \n]\S+")  # the same pieces, of a text in which blanks stand alone and none is at the end
_DOUBTFUL = "\u180e"  # a blank by some versions of Unicode only: such texts are encoded whole


@dataclass(frozen=True)
class Tokenizers:
    """A file of the tokenizers library, with byte-level tokens, and one of sentencepiece with byte fallback."""

    a: str
    b: str


def default_tokenizers() -> Tokenizers:
    return Tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def byte_level_bytes(token: str) -> bytes:
    """The bytes that a byte-level token stands for: printable Latin-1 characters are themselves, others are moved up."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_alphabet() -> dict[str, int]:
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(moved)}


_BYTE_OF = _byte_alphabet()


def pieces_are_independent(spec: dict, b: object) -> bool:
    """Whether both tokenizers encode a text as its pieces one by one."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(b.serialized_model_proto())
    rules = model.normalizer_spec
    words = [p.piece for p in model.pieces]
    return (
        spec.get("normalizer") is None
        and spec.get("pre_tokenizer") == _BYTE_LEVEL
        and not any(spec.get(x) for x in ("post_processor", "truncation", "padding"))
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and rules.name == "identity"
        and rules.add_dummy_prefix
        and not rules.remove_extra_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
        and not any(p.type == p.USER_DEFINED for p in model.pieces)
        and not any(SPACE_MARK in w.lstrip(SPACE_MARK) or "\n" in w or " " in w for w in words)
    )


def _marks(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """A bitset of n_bytes bits, packed, with a one at the last byte of each token."""
    bits = np.zeros(n_bytes, bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little")


def _rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ones there are up to and at the given bits."""
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    before = np.concatenate([[0], before])[at >> 3]
    return before + np.bitwise_count(bits[at >> 3] & ((2 << (at & 7)) - 1).astype(np.uint8))


def shared_cuts(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of both end, and how many tokens of A and of B end up to each. Both cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    if not len(a_ends):
        return (np.zeros(0, np.int64),) * 3
    a, b = (_marks(e, int(a_ends[-1])) for e in (a_ends, b_ends))
    cuts = np.flatnonzero(np.unpackbits(a & b, bitorder="little"))
    return cuts + 1, _rank(a, cuts), _rank(b, cuts)


class PairCounts:
    """Corpus-wide counts of the frequent pairs, by sorted code, and whether a count is its B id's highest."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts, self.best = codes[order], counts[order], best[order]

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, whether best, and which codes are not here (their count is 0)."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool), np.ones(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return np.where(known, self.counts[at], 0), known & self.best[at], ~known


class _Codes(_Table):
    """A table of the codes of pairs."""

    def __init__(self) -> None:
        super().__init__()
        self.flat = self.flat.astype(np.int64)


class Aligner:
    """Encodes and aligns pieces of texts, and keeps what is known of each distinct one."""

    def __init__(self, files: Tokenizers, by_piece: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        with open(files.a, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = pieces_are_independent(spec, self.b) if by_piece is None else by_piece
        of_a = {i: byte_level_bytes(t) for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.space = self.b.piece_to_id(SPACE_MARK)
        # Ids of A before another of their group and at its end, ids of B likewise, and ids of B at a piece's end.
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        ends = [(self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";"), (self.n_b, "")]
        self.names = [f"{i}{end}" for n, end in ends for i in range(n)]
        self.reset()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def reset(self) -> None:
        self.pieces, self.pairs = _Numbers(), _Codes()
        self.count, self.n_bytes = 0, 0
        self.n = np.zeros((4, 1 << 12), np.int64)  # of each piece: A tokens, B tokens, groups, and 1 if it has no tokens
        self.text: list[str] = []  # groups of each piece, as far as they were asked for
        self.ids: list[tuple[np.ndarray, ...]] = []  # what the texts of the other pieces are made of

    @property
    def full(self) -> bool:
        return self.count > MAX_PIECES or self.n_bytes > MAX_PIECE_BYTES

    def cut(self, text: str) -> list[str]:
        """Pieces of a space and the text."""
        if self.by_piece and _DOUBTFUL not in text:
            text = " " + text
            found = _PLAIN_PIECES.findall(text)
            return found if len("".join(found)) == len(text) else _PIECES.findall(text)
        return [" " + text]

    def _b_ids(self, pieces: list[str]) -> list[list[int]]:
        """sentencepiece adds the first space; a piece without one loses it again."""
        got = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [[self.space] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, got)]

    def learn(self) -> None:
        """Aligns the pieces that have a number and no entry yet."""
        new, self.pieces.new = self.pieces.new, []
        for k in range(0, len(new), 4096):
            self._add(new[k : k + 4096])

    def _add(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        self.n_bytes += sum(map(len, raw))
        found = self._joined(pieces, raw)
        if found is None and len(pieces) > 64:
            self.n_bytes -= sum(map(len, raw))
            for k in range(0, len(pieces), 64):
                self._add(pieces[k : k + 64])
            return
        self._align(*(found or self._one_by_one(pieces, raw)))

    def _joined(self, pieces: list[str], raw: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """Ids and their numbers per piece from texts of many pieces, if these are texts' pieces wherever they stand and
        all tokens together give back their bytes."""
        if not self.by_piece or any(p[0] not in " \n" or p[-1].isspace() or _DOUBTFUL in p for p in pieces):
            return None
        texts = ["".join(pieces[k : k + 128]) for k in range(0, len(pieces), 128)]
        a = np.fromiter((i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids), np.int64)
        b = np.fromiter((i for ids in self._b_ids(texts) for i in ids), np.int64)
        whole, ends = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        out = []
        for ids, of, lengths in ((a, self.a_bytes, self.a_length), (b, self.b_bytes, self.b_length)):
            if b"".join([of[i] for i in ids.tolist()]) != whole:
                return None
            token_ends = np.cumsum(lengths[ids])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                return None
            out += [ids, np.diff(last + 1, prepend=0)]
        return (*out, np.zeros(len(pieces), bool))

    def _one_by_one(self, pieces: list[str], raw: list[bytes]) -> tuple[np.ndarray, ...]:
        a_ids = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b_ids = self._b_ids(pieces)
        bad = np.zeros(len(pieces), bool)
        for i, want in enumerate(raw):
            if any(b"".join([of[x] for x in ids[i]]) != want for ids, of in ((a_ids, self.a_bytes), (b_ids, self.b_bytes))):
                bad[i], a_ids[i], b_ids[i] = True, [], []
        out = []
        for ids in (a_ids, b_ids):
            out += [np.array([x for one in ids for x in one], np.int64), np.array([len(x) for x in ids], np.int64)]
        return (*out, bad)

    def _align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, bad: np.ndarray) -> None:
        _, to_a, to_b = shared_cuts(self.a_length[a], self.b_length[b])
        # Every piece ends with a cut, so its groups are those up to its last A token.
        last = np.searchsorted(to_a, np.cumsum(n_a), side="right")
        n_groups = np.diff(last, prepend=0)
        self.pairs.add(a[to_a - 1] * PAIR_BASE + b[to_b - 1], n_groups)
        start, self.count = self.count, self.count + len(bad)
        while self.count > self.n.shape[1]:
            self.n = np.concatenate([self.n, np.zeros_like(self.n)], 1)
        self.n[:, start : self.count] = n_a, n_b, n_groups, bad
        self.ids.append((a.astype(np.int32), b.astype(np.int32), to_a.astype(np.int32), to_b.astype(np.int32), np.cumsum(n_a + n_b), last))

    def write_texts(self) -> None:
        """Makes the groups' texts of all pieces."""
        waiting, self.ids = self.ids, []
        for a, b, to_a, to_b, tokens, last in waiting:
            # Tokens in the order of their groups, those of A first; each with the sign that follows it.
            of_a = np.searchsorted(to_a, np.arange(len(a)), side="right")
            of_b = np.searchsorted(to_b, np.arange(len(b)), side="right")
            name_a, name_b = a.astype(np.int64), b.astype(np.int64) + 2 * self.n_a
            name_a[to_a - 1] += self.n_a
            name_b[to_b - 1] += self.n_b
            name_b[to_b[last[last > 0] - 1] - 1] = b[to_b[last[last > 0] - 1] - 1] + 2 * self.n_a + 2 * self.n_b
            order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
            names = [self.names[i] for i in np.concatenate([name_a, name_b])[order].tolist()]
            start = 0
            for stop in tokens.tolist():
                self.text.append("".join(names[start:stop]))
                start = stop

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts one after the other, and how many each text has. No text has none."""
        of, lengths = [], []
        for text in texts:
            found = self.cut(text) if text else []
            lengths.append(len(found))
            of.append(np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found)))
        self.learn()
        return np.concatenate(of) if of else np.zeros(0, np.int64), np.array(lengths, np.int64)


def _aligner(files: Tokenizers) -> Aligner:
    """The worker's own, with the pieces that it knows from earlier tasks."""
    return worker_table(files, lambda: Aligner(files))


def _sound(aligner: Aligner, of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text whether all its pieces have tokens."""
    return (_sums(aligner.n[3, of], lengths) == 0) & (lengths > 0)


def _count_pairs(files: Tokenizers):
    """Texts to the pairs that are linked in them, each with its count, once for each filling of the worker's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen = _aligner(files), np.zeros(1 << 12, np.int64)  # how often each piece was in a text of this task

        def counted() -> pa.RecordBatch:
            used = np.flatnonzero(seen)
            codes, lengths = aligner.pairs.take(used)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            counts = np.add.reduceat(np.repeat(seen[used], lengths)[order], starts) if len(starts) else starts
            return pa.RecordBatch.from_arrays([pa.array(codes[order][starts]), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                if aligner.full:
                    yield counted()
                    aligner.reset()
                    seen[:] = 0
                of, lengths = aligner.numbers(part.column(0).to_pylist())
                while aligner.count > len(seen):
                    seen = np.concatenate([seen, np.zeros_like(seen)])
                used = of[np.repeat(_sound(aligner, of, lengths), lengths)]
                seen += np.bincount(used, minlength=len(seen))
        yield counted()

    return run


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>"


def _describe(files: Tokenizers, table: Broadcast):
    """Ids and texts to their rows; `rare` has the codes of the links that the table does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = _aligner(files), table.value
        of_piece, rare = np.zeros((2, 0), np.int64), _Codes()  # count sums and best links of each piece; its rare codes

        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                if aligner.full:
                    aligner.reset()
                    of_piece, rare = np.zeros((2, 0), np.int64), _Codes()
                texts = part.column(1).to_pylist()
                of, lengths = aligner.numbers(texts)
                aligner.write_texts()
                new = np.arange(of_piece.shape[1], aligner.count)
                codes, n_links = aligner.pairs.take(new)
                count, best, unknown = counts.take(codes)
                of_piece = np.concatenate([of_piece, [_sums(count, n_links), _sums(best.astype(np.int64), n_links)]], 1)
                rare.add(codes[unknown], _sums(unknown.astype(np.int64), n_links))
                sound = _sound(aligner, of, lengths)
                n_a, n_b, n_groups, _ = (np.where(sound, _sums(x[of], lengths), 0) for x in aligner.n)
                count_sum, n_best = (np.where(sound, _sums(x[of], lengths), 0) for x in of_piece)
                digests, at = [], 0
                for ok, n in zip(sound.tolist(), lengths.tolist()):
                    own = of[at : at + n].tolist() if ok else []
                    digests.append(hashlib.sha256(";".join([aligner.text[i] for i in own]).encode()).hexdigest() if ok else "")
                    at += n
                used = np.repeat(sound, lengths)
                flat, per_piece = rare.take(of[used])
                per_text = _sums(per_piece, np.where(sound, lengths, 0))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
                numbers = [pa.array(x) for x in (n_a, n_b, n_groups, n_groups, n_best, count_sum)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *numbers, pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=[c.split()[0] for c in _ROW.split(", ")],
                )

    return run


def pair_counts(docs: DataFrame, text: str = "text", files: Tokenizers | None = None) -> DataFrame:
    """a, b, n and best for each pair of ids that some text links: links of the whole corpus, and whether no other A id has
    more with the same B id. Repeated rows count again. Null and empty texts, and those that a tokenizer does not give
    back byte by byte, have no links. The result is materialized."""
    found = docs.select(F.col(text)).mapInArrow(trimmed(_count_pairs(files or default_tokenizers())), "pair long, n long")
    counts = found.groupBy("pair").agg(F.sum("n").alias("n"))
    base = F.lit(PAIR_BASE)
    counts = materialize(counts.select(F.floor(F.col("pair") / base).alias("a"), F.pmod("pair", base).alias("b"), "n"), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("_most"))
    out = counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))
    out = materialize(out, "pair-counts")
    drop_scratch(counts)
    return out


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files: Tokenizers | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose count is their B id's
    highest), count_sum (of the links' counts) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have zeros and an empty digest.
    Texts of any length are taken whole, repeated rows get equal rows, other columns are not read; an empty table gives
    no row. Counts of the BROADCAST_PAIRS most frequent pairs at most go to every worker; links of rarer ones are joined.
    """
    spark, files = docs.sparkSession, files or default_tokenizers()
    counts = pair_counts(docs, text, files)
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for power, n in sizes:
        total += n
        if total > BROADCAST_PAIRS:
            break
        least = 1 << int(power)
    some = total > BROADCAST_PAIRS
    code = (F.col("a") * F.lit(PAIR_BASE) + F.col("b")).alias("code")
    often = counts.filter(F.col("n") >= least).select(code, "n", "best").toArrow()
    table = spark.sparkContext.broadcast(PairCounts(*(often.column(i).to_numpy() for i in range(3))))
    typed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = typed.mapInArrow(trimmed(_describe(files, table)), _ROW)
    if not some:
        drop_scratch(counts)
        return rows.drop("rare")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("_row", F.explode("rare").alias("code")).groupBy("_row", "code").agg(F.count("*").alias("_times"))
    counted = links.join(counts.filter(F.col("n") < least).select(code, "n", "best"), "code")
    more = counted.groupBy("_row").agg(
        F.sum(F.col("_times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_times"))).alias("_best")
    )
    out = rows.join(more, "_row", "left")
    out = out.withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).drop("_row", "rare", "_sum", "_best")
    out = materialize(out, "alignments")
    drop_scratch(rows, counts)
    return out
