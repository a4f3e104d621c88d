"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled documents on the executors; only the count matrix, of fixed
size (languages x buckets), comes to the driver. Its log-probabilities are broadcast, and batches of whole texts are
scored as sparse rows (bucket indices and row pointers) against it in numpy. Documents of any length are scored in
full: a long text is only cut into pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15
SIZES = (1, 2, 3)
FULL_WIDTH = 256  # languages up to which each size has 2**BUCKET_BITS buckets; more share fewer, so a model stays bounded
SAMPLE_DOCS = 20_000  # labelled documents that a model is fitted on, about: all of them if there are fewer
TRAIN_TASKS = 12
PIECE = 1 << 19  # code points that one numpy pass takes
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # len(SIZES) * 2**bits x languages, float32
    log_prior: np.ndarray
    bits: int = BUCKET_BITS


def bits_for(languages: int) -> int:
    return max(8, BUCKET_BITS - max(0, (languages - 1) // FULL_WIDTH).bit_length())


def _buckets(points: np.ndarray, size: int, n: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket of the n-gram of `size` that begins at each of the first n code points; sizes have buckets of their own."""
    h = points[:n] * _MIX[0]
    for k in range(1, size):
        h = (h ^ (h >> np.uint32(15))) * _MIX[1] + points[k : n + k] * _MIX[2]
    h ^= h >> np.uint32(13)
    h *= _MIX[1]
    return (h >> np.uint32(32 - bits)).astype(np.int32) + np.int32((size - 1) << bits)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts together, the first index of each part, and whose part it is.

    After each part of a text stand the points that n-grams of its last positions reach into, blanks after the text's
    end; they are a part of nobody (-1), so each position of a text counts once and no text reaches into another.
    """
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    tail = max(SIZES) - 1
    for i, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, len(points), PIECE):
            part, after = points[start : start + PIECE], points[start + PIECE : start + PIECE + tail]
            held += [part, np.concatenate([after, np.full(tail - len(after), 32, np.uint32)])]
            owners += [i, -1]
            size += len(part)
            if size >= PIECE:
                yield _joined(held), _starts(held), np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield _joined(held), _starts(held), np.array(owners)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*parts, np.full(max(SIZES), 32, np.uint32)])


def _starts(parts: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(p) for p in parts])
    return np.cumsum(lengths) - lengths


def _count_batches(languages: tuple[str, ...]):
    bits = bits_for(len(languages))
    width = len(SIZES) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), width), np.int64)
        docs = np.zeros(len(languages), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()])
            docs += np.bincount(langs, minlength=len(languages))
            for points, starts, owners in _pieces(texts):
                n = len(points) - max(SIZES)
                lang = np.repeat(np.where(owners < 0, -1, langs[owners]), np.diff(np.append(starts, n)))
                for size in SIZES:
                    flat = (lang * width + _buckets(points, size, n, bits))[lang >= 0]
                    counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        for i in np.flatnonzero(docs):
            yield pa.RecordBatch.from_pydict({"lang": [int(i)], "docs": [int(docs[i])], "counts": [counts[i].astype(np.int32).tobytes()]})

    return run


def fit(docs: DataFrame, lang: str = "lang", where: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fits on about sample_docs documents with text and language, chosen by a hash of the text over the whole table.

    Documents with a null text or language, or outside `where`, take no part. Without any, the model knows no language.
    Every language of the others is learned, however rare. sample_docs bounds the sample in expectation: a text's
    repetitions come together or not at all.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col(lang).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    languages, total = tuple(sorted(sizes)), sum(sizes.values())
    bits = bits_for(len(languages))
    width = len(SIZES) << bits
    if not languages:
        return LanguageModel((), np.zeros((width, 0), np.float32), np.zeros(0), bits)
    # A rare language keeps more of its documents than a common one: each language's quota is filled by its own share.
    quota = max(1, sample_docs // len(languages))
    spare = max(0, sample_docs - sum(min(quota, n) for n in sizes.values()))
    wanting = sum(n - quota for n in sizes.values() if n > quota)
    rates = {name: min(1.0, (quota + spare * (n - quota) / wanting) / n) for name, n in sizes.items() if n > quota}
    rate = F.lit(1.0)
    if rates:
        of = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])
        rate = F.coalesce(F.try_element_at(of, F.col(lang)), F.lit(1.0))
    pick = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < rate * (1 << 20)
    sample = rows.filter(pick).select("text", lang).repartition(TRAIN_TASKS)
    parts = sample.mapInArrow(_count_batches(languages), "lang long, docs long, counts binary").collect()
    counts, n_docs = np.zeros((len(languages), width)), np.zeros(len(languages))
    for r in parts:
        counts[r["lang"]] += np.frombuffer(r["counts"], np.int32)
        n_docs[r["lang"]] += r["docs"]
    smooth = 0.5
    log_prob = np.empty((width, len(languages)), np.float32)
    for k in range(len(SIZES)):  # a distribution over the buckets of each size
        block = slice(k << bits, (k + 1) << bits)
        own = counts[:, block] + smooth
        log_prob[block] = np.log(own / own.sum(1, keepdims=True)).T
    prior = np.array([sizes[x] for x in languages]) / total
    return LanguageModel(languages, log_prob, np.log(prior), bits)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text; `und` and 0 without a letter or without a model."""
    width = len(model.languages)
    sums = np.zeros((len(texts), max(1, width)))
    if width:
        for points, starts, owners in _pieces(texts):
            n = len(points) - max(SIZES)
            total = np.zeros((len(starts), width))
            for size in SIZES:
                at = _buckets(points, size, n, model.bits)
                for j in range(width):
                    total[:, j] += np.add.reduceat(model.log_prob[:, j][at].astype(np.float64), starts)
            np.add.at(sums, owners[owners >= 0], total[owners >= 0])
        sums += model.log_prior
    best = sums.argmax(1)
    top = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not width or not text or not any(map(str.isalpha, text)):
            names.append(UNKNOWN)
        else:
            names.append(model.languages[best[i]])
            scores[i] = top[i]
    return names, scores


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score to doc_id. Only text is read; ties go to the first language in alphabetical order.

    Null texts and texts without a letter are `und` with score 0. Repeated rows get equal results, texts of any length are
    scored whole, other columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 256 x 3 x 2**15 floats, or 8 more buckets a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                names, scores = score_texts(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
