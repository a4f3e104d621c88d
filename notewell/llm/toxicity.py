"""Toxicity: a small convolutional text classifier, trained and applied in numpy.

Words are hashed to rows of an embedding table; filters of several widths slide over the whole text; each filter's
maximum feeds a logistic unit. The model is fitted on a bounded sample of labelled documents, whose words reach the
driver as hashed integers; scoring covers every word of every text. Decision thresholds are calibrated by language on
part of the sample; the score itself depends on the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import release_memory, slices, trimmed, worker_table

BUCKET_BITS = 19
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
SAMPLE_DOCS = 8_000  # labelled documents that a model is fitted on, about
SAMPLE_WORDS = 20_000  # words of a document up to which it can be in the sample; all documents are scored
THRESHOLD = 0.7
WORD_SHARE = 1 / 1280  # of the sample's documents that have to hold a word for it to have an embedding, two at least
MIN_OF_CLASS = 20  # calibration documents of each class that a language needs for a threshold of its own
PIECE = 1 << 16  # words that one numpy pass takes
_GAP = max(WIDTHS) - 1
_KEEP = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))
_MAX_WORDS = 150_000


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # row 0 is the gap between texts and stays zero
    kernel: np.ndarray  # DIM x (sum of widths) * FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD


def word_ids(text: str | None) -> np.ndarray:
    """Hashed words of a text: lower case, cut at ASCII characters that are neither letters nor digits."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
    known = worker_table("toxicity", dict)
    if len(known) > _MAX_WORDS:
        known.clear()
    out = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        n = known.get(w)
        if n is None:
            n = known[w] = 1 + zlib.crc32(w) % ((1 << BUCKET_BITS) - 1)
        out[i] = n
    return out


def _laid_out(docs: list[np.ndarray], more: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, and where the positions of each begin and stop.

    A text's positions are its words and a gap of zeros, and more zeros follow, so no filter reaches into another text.
    Of a piece that the text goes on behind (more), the last words are there to be reached into only.
    """
    lengths = np.array([len(d) for d in docs])
    starts = np.cumsum(lengths + 2 * _GAP) - lengths - 2 * _GAP
    stops = starts + lengths + np.where(more, -_GAP, _GAP) if more is not None else starts + lengths + _GAP
    ids = np.zeros(int((lengths + 2 * _GAP).sum()) + _GAP, np.int32)
    for s, d in zip(starts, docs):
        ids[s : s + len(d)] = d
    return ids, starts, stops


def _responses(kernel: np.ndarray, x: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each width, the filters' responses at each of the first n positions."""
    y = x @ kernel
    at = 0
    for width in WIDTHS:
        r = y[:n, at : at + FILTERS]
        for k in range(1, width):
            r = r + y[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
        at += width * FILTERS
        yield r


def score_ids(model: ToxicityModel, docs: list[np.ndarray]) -> np.ndarray:
    """Probability of the toxic label for each array of word ids; long texts are taken in overlapping pieces."""
    pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    held: list[np.ndarray] = []
    more: list[bool] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        ids, starts, stops = _laid_out(held, more)
        n = len(ids) - _GAP
        x = model.embedding[ids]
        cuts = np.stack([starts, stops], axis=1).ravel()
        best = np.hstack([np.maximum.reduceat(r, cuts, axis=0)[::2] for r in _responses(model.kernel, x, n)])
        np.maximum.at(pooled, np.array(owners), best)

    for i, d in enumerate(docs):
        for start in range(0, max(1, len(d)), PIECE):
            held.append(d[start : start + PIECE + _GAP])
            more.append(start + PIECE < len(d))
            if more[-1] and len(held[-1]) < PIECE + _GAP:
                held[-1] = np.append(held[-1], np.zeros(PIECE + _GAP - len(held[-1]), np.int32))
            owners.append(i)
            size += len(held[-1])
            if size >= PIECE:
                flush()
                held, more, owners, size = [], [], [], 0
    if held:
        flush()
    if not len(docs):
        return np.zeros(0)
    z = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.m, self.v, self.t = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        self.t += 1
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.999 * self.v[at] + 0.001 * grad**2
        m, v = self.m[at] / (1 - 0.9**self.t), self.v[at] / (1 - 0.999**self.t)
        self.value[at] -= self.rate * m / (np.sqrt(v) + 1e-8)


def _associations(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of enough documents, and how far the number of those with label 1 is from chance: in standard deviations,
    drawn towards zero for rare words, a quarter each and at most one either way."""
    size = 1 << BUCKET_BITS
    n, ones = np.zeros(size), np.zeros(size)
    for d, y in zip(docs, labels):
        words = np.unique(d)
        n[words] += 1
        ones[words] += y
    common = np.flatnonzero(n >= max(2, WORD_SHARE * len(docs)))
    share = labels.mean() if len(labels) else 0.0
    off = (ones[common] - share * n[common]) / np.sqrt(share * (1 - share) * n[common] + 1)
    return common, np.clip(off / 4, -1, 1).astype(np.float32)


def train(
    docs: list[np.ndarray],
    labels: np.ndarray,
    held_docs: list[np.ndarray] | None = None,
    held_labels: np.ndarray | None = None,
    seed: int = 7,
    rate: float = 1e-2,
) -> ToxicityModel:
    """Fits by Adam on the logistic loss; gradients reach only the words at which a filter had its maximum.

    Words of fewer than WORD_SHARE of the documents keep a zero embedding, and so do words never seen. The first component
    of the others begins with how much oftener than by chance they stand in documents of label 1, so that a few hundred
    documents are enough. With held-out documents, the epoch with the least loss on them is kept.
    """
    rng = np.random.default_rng(seed)
    columns = sum(WIDTHS) * FILTERS
    emb = _Adam(np.zeros((1 << BUCKET_BITS, DIM), np.float32), rate)
    common, apart = _associations(docs, labels)
    emb.value[common] = rng.normal(0, 0.1, (len(common), DIM))
    emb.value[common, 0] += apart
    trained = np.zeros(1 << BUCKET_BITS, bool)
    trained[common] = True
    kernel = _Adam(rng.normal(0, 0.5, (DIM, columns)).astype(np.float32), rate)
    bias = _Adam(np.zeros(len(WIDTHS) * FILTERS, np.float32), rate)
    out = _Adam(np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32) * np.tile([1, 1, 1, -1], 99)[: len(WIDTHS) * FILTERS], rate)
    base = np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4)
    top = _Adam(np.array([np.log(base / (1 - base))], np.float32), rate)
    made = lambda: ToxicityModel(emb.value, kernel.value, bias.value, out.value, float(top.value[0]))
    if not 0 < labels.sum() < len(labels):
        out.value[:] = 0
        return made()
    best, least = None, np.inf
    for _ in range(int(np.clip(36_000 // len(docs), 5, 100))):
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
            _step(emb, kernel, bias, out, top, trained, [docs[i] for i in some], labels[some], rng)
        if held_docs:
            p = np.clip(score_ids(made(), held_docs), 1e-6, 1 - 1e-6)
            loss = -np.mean(np.where(held_labels > 0, np.log(p), np.log(1 - p)))
            if loss < least:
                best, least = tuple(x.value.copy() for x in (emb, kernel, bias, out, top)), loss
    if best:
        for x, value in zip((emb, kernel, bias, out, top), best):
            x.value = value
    return made()


def _step(emb, kernel, bias, out, top, trained, docs: list[np.ndarray], labels: np.ndarray, rng) -> None:
    ids, starts, stops = _laid_out(docs)
    n = len(ids) - _GAP
    x = emb.value[ids]
    where, best = [], []
    for r in _responses(kernel.value, x, n):
        peak = np.stack([r[a:b].argmax(0) + a for a, b in zip(starts, stops)])
        where.append(peak)
        best.append(np.take_along_axis(r, peak, 0))
    peaks, raw = np.hstack(where), np.hstack(best) + bias.value
    kept = (rng.random(raw.shape) < 0.7).astype(np.float32) / 0.7
    hidden = np.maximum(raw, 0) * kept
    z = hidden @ out.value + top.value[0]
    err = (1 / (1 + np.exp(-z)) - labels).astype(np.float32) / len(labels)
    g_hidden = np.outer(err, out.value) * (raw > 0) * kept
    g_kernel = 1e-5 * kernel.value
    touched, g_rows = [], []
    at = 0
    for w, width in enumerate(WIDTHS):
        block = slice(w * FILTERS, (w + 1) * FILTERS)
        g, p = g_hidden[:, block], peaks[:, block]
        for k in range(width):
            cols = np.arange(at, at + FILTERS)
            word = ids[p + k]
            g_kernel[:, cols] += np.einsum("df,dfe->ef", g, emb.value[word])
            touched.append(word.ravel())
            g_rows.append((g[:, :, None] * kernel.value[:, cols].T[None]).reshape(-1, DIM))
            at += FILTERS
    rows, back = np.unique(np.concatenate(touched), return_inverse=True)
    g_emb = np.zeros((len(rows), DIM), np.float32)
    np.add.at(g_emb, back, np.concatenate(g_rows))
    out.step(hidden.T @ err + 1e-4 * out.value)
    top.step(np.array([err.sum()], np.float32))
    bias.step(g_hidden.sum(0))
    kernel.step(g_kernel)
    emb.step(g_emb[trained[rows]], rows[trained[rows]])


def _enough(labels: np.ndarray, least: int = MIN_OF_CLASS) -> bool:
    return labels.sum() >= least and len(labels) - labels.sum() >= least


def _best_threshold(scores: np.ndarray, labels: np.ndarray, low: float, near: float) -> float:
    """Of a grid from low to 0.9, the value with the best F0.5 (a clean document lost is worse than a toxic one kept);
    the nearest to `near` among equals."""
    grid = sorted(np.round(np.arange(low, 0.91, 0.05), 2), key=lambda t: abs(t - near))
    f = [1.25 * labels[scores >= t].sum() / max(1, (scores >= t).sum() + 0.25 * labels.sum()) for t in grid]
    return float(grid[int(np.argmax(f))])


def calibrate(model: ToxicityModel, docs: list[np.ndarray], labels: np.ndarray, langs: np.ndarray) -> None:
    """Shifts the scores so that the best decision over all calibration documents is at THRESHOLD, then sets the
    threshold of every language with enough of them."""
    scores = score_ids(model, docs)
    best = _best_threshold(scores, labels, 0.35, 0.5) if _enough(labels, 5) else 0.5
    model.out_bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(best / (1 - best)))
    scores = score_ids(model, docs)
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        if _enough(labels[own]):
            model.thresholds[lang] = _best_threshold(scores[own], labels[own], 0.5, THRESHOLD)


def _ids_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [word_ids(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d.tobytes() for d in ids], pa.binary()), batch.column(1), batch.column(2)], names=["ids", "label", "lang"]
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    where: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
    sample_words: int = SAMPLE_WORDS,
) -> ToxicityModel:
    """Fits on about sample_docs labelled documents, chosen by a hash of doc_id over the whole table.

    The sample is bounded by two parameters: its documents (in expectation) and the words of each of them; longer
    documents are scored like all others but not learned from. labels: doc_id and a label of 0 or 1; rows with nulls
    take no part, of several labels of one document the greatest counts. Documents outside `where` take no part, rows
    that repeat a doc_id count one by one. A fifth of the sample chooses the epoch and calibrates the thresholds. Without
    labels of both kinds all scores are equal.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("_label")).dropna().filter("_label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    pick = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull())
    if where is not None:
        marks, pick = marks.filter(where), pick.filter(where)
    total = marks.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample_docs / max(1, total))))
    marks, pick = marks.filter(chance), pick.filter(chance)
    rows = pick.join(marks, "doc_id").select("text", "_label", F.coalesce("lang", F.lit("")).alias("lang"))
    found = rows.mapInArrow(_ids_batches, "ids binary, label int, lang string").filter(F.length("ids") <= 4 * sample_words)
    got = sorted(found.collect(), key=lambda r: (zlib.crc32(r["ids"]), r["label"]))  # the order of rows never matters
    texts = [np.frombuffer(r["ids"], np.int32) for r in got]
    y, langs = np.array([r["label"] for r in got], np.float32), np.array([r["lang"] for r in got], object)
    held = np.arange(len(got)) % 5 == 0
    checks = [t for t, h in zip(texts, held) if h]
    model = train([t for t, h in zip(texts, held) if not h], y[~held], checks, y[held])
    calibrate(model, checks, y[held], langs[held])
    del got, texts, checks
    release_memory()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of docs, `toxic_score` from the text alone, and `toxic_flag`: score at least the language's threshold.

    Null and empty texts get the score of a text without words, repeated rows get equal scores, texts of any length are
    scored whole, an empty table stays empty. An input column of these names is replaced, other columns stay.
    """
    docs = docs.drop("toxic_score", "toxic_flag")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**19 x 8 floats, whatever the data
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 4 << 20, 1000):
                scores = score_ids(shared.value, [word_ids(t) for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "toxic_score"])

    bar = F.lit(model.threshold)
    if "lang" in docs.columns:
        for lang, t in model.thresholds.items():
            bar = F.when(F.col("lang") == lang, F.lit(t)).otherwise(bar)
    return docs.mapInArrow(trimmed(run), schema).withColumn("toxic_flag", F.col("toxic_score") >= bar)
