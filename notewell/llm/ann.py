"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree cuts the unit sphere by hyperplanes between the means of two random halves of a node's sample, at the sample
median; its depth follows the number of vectors. A query walks all trees through one shared priority queue (least
distance to any hyperplane crossed first) and opens a fixed number of leaves; the leaves' vectors are then ranked by
exact cosine in double precision.

The forest is fitted on a bounded sample, every vector is indexed. How many leaves a query opens is set from the sample
too: the least number at which the forest reaches the wanted recall on it against brute force. A leaf that outgrows
the sample's depth is dealt out in blocks, and each block is split further by a tree of its own vectors, so that a query
looks at a bounded part of a block. Vectors travel once per tree, queries once per leaf that they open. Equal vectors
are indexed once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_scratch, materialize

TREES = 8
LEAF = 128  # vectors wanted in a leaf
MAX_DEPTH = 12
SAMPLE = 32_768  # vectors that the forest is fitted on, at most
SAMPLE_QUERIES = 200
RECALL = 0.97  # on the sample
BLOCK = 16_384  # vectors of one leaf that are ranked together
WHOLE = 4_096  # vectors of a block up to which a query looks at all of them
HELD_ROWS = 500_000  # of three numbers, that a task holds of what it has found
DIGITS = 12  # scores that agree so far are ties
SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Forest:
    depth: int
    planes: np.ndarray  # trees x (2**depth - 1) x dimensions
    cuts: np.ndarray
    opened: int = 1  # leaves that a query opens

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each row of unit vectors in each tree."""
        out = np.zeros((len(self.planes), len(unit)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, planes[node]) >= cuts[node])
            out[t] = node - (2**self.depth - 1)
        return out

    def open_leaves(self, unit: np.ndarray, counts: np.ndarray, most: int, least: int = 0) -> list[tuple[int, int]]:
        """The first `most` leaves with vectors, in the order of the shared queue (counts: trees x leaves), and more until
        one tree's, which share no vector, hold `least` vectors or all."""
        first = 2**self.depth - 1
        side = self.planes @ unit - self.cuts if self.depth else np.zeros((len(self.planes), 0))
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        out: list[tuple[int, int]] = []
        seen = np.zeros(len(self.planes), np.int64)
        while queue and (len(out) < most or seen.max() < least):
            crossed, t, node = heapq.heappop(queue)
            while node < first:
                m = side[t, node]
                heapq.heappush(queue, (max(crossed, abs(m)), t, 2 * node + (1 if m >= 0 else 2)))
                node = 2 * node + (2 if m >= 0 else 1)
            if counts[t, node - first]:
                out.append((t, node - first))
                seen[t] += counts[t, node - first]
        return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _plane(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    w = np.zeros(x.shape[1])
    if len(x) > 1:
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            near = x @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        w = a - b
    if not np.linalg.norm(w) > 1e-9:
        w = rng.normal(size=x.shape[1])
    return w / np.linalg.norm(w)


def _grown(unit: np.ndarray, depth: int, trees: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, 2**depth - 1, unit.shape[1])), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        inside = {0: np.arange(len(unit))}
        for node in range(2**depth - 1):
            rows = inside.pop(node)
            planes[t, node] = _plane(unit[rows], rng)
            side = unit[rows] @ planes[t, node]
            cuts[t, node] = np.median(side) if len(side) else 0.0
            inside[2 * node + 1], inside[2 * node + 2] = rows[side < cuts[t, node]], rows[side >= cuts[t, node]]
    return Forest(depth, planes, cuts)


def fit_forest(sample: np.ndarray, n_vectors: int, k: int = 5, trees: int = TREES, recall: float = RECALL, seed: int = 5) -> Forest:
    """sample: vectors, at least one; n_vectors: how many will be indexed. Two vectors or more make a tree with a cut."""
    unit = _units(sample)
    wanted = int(np.ceil(np.log2(max(2, n_vectors) / LEAF)))
    depth = min(max(1, wanted), MAX_DEPTH, int(np.log2(max(2, len(unit) / 8)))) if n_vectors > 1 else 0
    forest = _grown(unit, depth, trees, seed)
    leaves = forest.leaves(unit)
    counts = np.stack([np.bincount(x, minlength=2**depth) for x in leaves])
    queries = np.random.default_rng(seed + 1).permutation(len(unit))[:SAMPLE_QUERIES]
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -2
    take = min(k, len(unit) - 1)
    best = np.argsort(-near, axis=1)[:, :take]
    needed = []  # for each neighbour, how many leaves are opened before it is seen
    for q, found in zip(queries, best):
        rank = {x: i + 1 for i, x in enumerate(forest.open_leaves(unit[q], counts, counts.size))}
        needed += [min(rank[(t, leaves[t, b])] for t in range(trees)) for b in found]
    forest.opened = int(np.quantile(needed, recall, method="higher")) if needed else 1
    return forest


def clean_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part; other columns are not read.

    Null ids, and vectors null, empty, zero or with null or non-finite components take no part. Of rows that repeat an
    id, the one with the least vector counts. Arrays of floats stay so, others become arrays of doubles.
    """
    v = F.col("vector")
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    typed = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    good = typed.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _dims(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rank_block(queries: np.ndarray, members: np.ndarray, gids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (number, gids, scores) of its k + 1 nearest members, ties by gid; scores are exact cosines."""
    m = members.astype(np.float64)
    m_norm = np.sqrt((m * m).sum(1))
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256].astype(np.float64)
        q_norm = np.sqrt((part * part).sum(1))
        rough = (part @ m.T) / m_norm / q_norm[:, None]
        at = max(0, len(m) - k - 1)
        least = np.partition(rough, at, axis=1)[:, at] - 1e-9  # room for rounding, and all ties
        for i, row in enumerate(rough):
            some = np.flatnonzero(row >= least[i])
            exact = (part[i] * m[some]).sum(1) / (q_norm[i] * m_norm[some])
            order = np.lexsort((gids[some], -np.round(exact, DIGITS)))[: k + 1]
            yield start + i, gids[some][order], exact[order]


def best_of_each(qids: np.ndarray, gids: np.ndarray, scores: np.ndarray, most: int) -> list[np.ndarray]:
    """The `most` nearest different gids of each query, ties by gid."""
    order = np.lexsort((gids, -np.round(scores, DIGITS), qids))
    qids, gids, scores = qids[order], gids[order], scores[order]
    first = np.ones(len(qids), bool)
    first[1:] = (qids[1:] != qids[:-1]) | (gids[1:] != gids[:-1])  # a gid has the same score in every block
    qids, gids, scores = qids[first], gids[first], scores[first]
    starts = np.flatnonzero(np.diff(qids, prepend=qids[:1] - 1)) if len(qids) else np.zeros(0, np.int64)
    place = np.arange(len(qids)) - np.repeat(starts, np.diff(np.append(starts, len(qids))))
    return [x[place < most] for x in (qids, gids, scores)]


class _Block:
    """Members of one block of a leaf, and the queries that look at it."""

    def __init__(self, members: np.ndarray, gids: np.ndarray, k: int):
        self.members, self.gids, self.k = members, gids, k
        self.inner: Forest | None = None
        if len(gids) > WHOLE:
            unit = _units(members)
            self.inner = _grown(unit, int(np.log2(len(gids) / LEAF)), 1, 11)
            leaf = self.inner.leaves(unit)[0]
            self.by_leaf = np.split(np.argsort(leaf, kind="stable"), np.cumsum(np.bincount(leaf, minlength=2**self.inner.depth))[:-1])
            self.counts = np.array([[len(x) for x in self.by_leaf]])

    def ranked(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if self.inner is None:
            yield from rank_block(queries, self.members, self.gids, self.k)
            return
        for i, unit in enumerate(_units(queries)):
            opened = self.inner.open_leaves(unit, self.counts, WHOLE // LEAF, self.k + 1)
            some = np.concatenate([self.by_leaf[leaf] for _, leaf in opened])
            for _, gids, scores in rank_block(queries[i : i + 1], self.members[some], self.gids[some], self.k):
                yield i, gids, scores


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The k nearest found for each query: query_id, rank from 1, vec_id, score (cosine).

    rows: clean vectors (see clean_vectors). queries: some of their ids as `vec_id`; a query's own row is no candidate.
    Only vectors of the query's length are candidates. Scores that agree to DIGITS digits are ties, ranked by vec_id.
    Without rows or queries the result is empty.
    """
    rows = materialize(rows.withColumn("_size", F.size("vector")), "ann-rows")
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    # Vectors of one table have one length; those of other lengths are indexed apart.
    found = [
        _nearest(rows.filter(F.col("_size") == size).drop("_size"), asked.filter(F.col("_size") == size).select("vec_id"), k, trees, recall)
        for size in sorted(r[0] for r in asked.select("_size").distinct().collect())
    ]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], SCHEMA)


def _nearest(rows: DataFrame, queries: DataFrame, k: int, trees: int, recall: float) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    # Of equal vectors only the k + 1 least ids can be among the nearest of any query.
    firsts = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    salted = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("_s")).agg(F.min("vec_id").alias("_m"), firsts.alias("ids"))
    groups = salted.groupBy("vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    groups = materialize(groups.withColumn("gid", F.col("ids")[0]), "ann-groups")
    n = groups.count()
    asked = rows.join(queries, "vec_id", "left_semi").join(groups.select("vector", "gid"), "vector")
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "gid"), "ann-queries")
    sample = groups.select("vector", F.xxhash64("gid", F.lit(3)).alias("_h"), "gid").orderBy("_h", "gid").limit(SAMPLE)
    forest = fit_forest(_dims(sample.select("vector").toArrow().column(0).combine_chunks()), n, k, trees, recall)
    shared = spark.sparkContext.broadcast(forest)  # trees x 2**12 planes at most
    n_leaves = 2**forest.depth

    def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, n_leaves), np.int64)
        for b in batches:
            for t, leaf in enumerate(shared.value.leaves(_units(_dims(b.column(0))))) if b.num_rows else ():
                total[t] += np.bincount(leaf, minlength=n_leaves)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

    counts = np.zeros(trees * n_leaves, np.int64)
    for cell, c in groups.select("vector").mapInArrow(count_leaves, "cell long, n long").groupBy("cell").sum("n").collect():
        counts[cell] = c  # at most trees x 2**12 rows
    counts = counts.reshape(trees, n_leaves)
    blocks = -(-counts // BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                gid = part.column(1).to_numpy()
                leaves = shared.value.leaves(_units(_dims(part.column(0))))
                row = np.tile(np.arange(len(gid)), trees)
                tree = np.repeat(np.arange(trees), len(gid))
                block = ((gid[row] * np.int64(2654435761)) >> 7) % np.maximum(1, blocks[tree, leaves.ravel()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree * n_leaves + leaves.ravel()), pa.array(block.astype(np.int32)), pa.array(np.zeros(len(row), np.int32)), pa.array(gid[row]), part.column(0).take(pa.array(row))],
                    names=["cell", "block", "kind", "gid", "vector"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 50):
                part = b.slice(start, 50)
                cells, block, row = [], [], []
                for i, unit in enumerate(_units(_dims(part.column(0)))):
                    for t, leaf in shared.value.open_leaves(unit, counts, forest.opened, k + 1):
                        for x in range(blocks[t, leaf]):
                            cells.append(t * n_leaves + leaf)
                            block.append(x)
                            row.append(i)
                at = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), pa.array(block, pa.int32()), pa.array(np.ones(len(row), np.int32)), part.column(1).take(at), part.column(0).take(at)],
                    names=["cell", "block", "kind", "gid", "vector"],
                )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of cell, block and kind: a block's members, then the queries that look at it."""
        key, held, block = None, [], None
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]
        best = none  # of each query in this task's blocks, so that few rows are shuffled
        batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["qid", "gid", "score"])
        for b in batches:
            if not b.num_rows:
                continue
            cell, number, kind, gid = (b.column(i).to_numpy() for i in range(4))
            vectors = _dims(b.column(4))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            qids, gids, scores = [], [], []
            for a, z in zip(np.append(0, cuts), np.append(cuts, len(cell))):
                if (cell[a], number[a]) != key:
                    key, held, block = (cell[a], number[a]), [], None
                if kind[a] == 0:
                    held.append((vectors[a:z], gid[a:z]))
                    continue
                if block is None and held:
                    block, held = _Block(*(np.concatenate(x) for x in zip(*held)), k), []
                if block is not None:
                    for i, found, score in block.ranked(vectors[a:z]):
                        qids.append(np.full(len(found), gid[a + i]))
                        gids.append(found)
                        scores.append(score)
            best = [np.concatenate([x, *y]) for x, y in zip(best, (qids, gids, scores))]
            if len(best[0]) > HELD_ROWS:
                best = best_of_each(*best, k + 1)
                if 2 * len(best[0]) > HELD_ROWS:  # of more queries than a task should hold
                    yield batch_of(best)
                    best = none
        yield batch_of(best_of_each(*best, k + 1))

    shape = f"cell long, block int, kind int, gid long, vector {dict(groups.dtypes)['vector']}"
    members = groups.select("vector", "gid").mapInArrow(place, shape)
    asks = groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("vector", "gid").mapInArrow(ask, shape)
    placed = members.union(asks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "block")
    pairs = placed.sortWithinPartitions("cell", "block", "kind").mapInArrow(rank, "qid long, gid long, score double")
    level = F.round("score", DIGITS)
    best_groups = W.partitionBy("qid").orderBy(level.desc(), "gid")
    top = (
        pairs.groupBy("qid", "gid").agg(F.max("score").alias("score"))
        .withColumn("_r", F.row_number().over(best_groups))
        .filter(F.col("_r") <= k + 1)
        .join(groups.select("gid", "ids"), "gid")
        .select("qid", F.explode("ids").alias("vec_id"), "score")
    )
    top = materialize(top, "ann-top")
    ranks = W.partitionBy("query_id").orderBy(level.desc(), "vec_id")
    out = (
        asked.join(top, F.col("gid") == F.col("qid"))
        .filter("vec_id != query_id")
        .withColumn("rank", F.row_number().over(ranks))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
    out = materialize(out, "ann-found")
    drop_scratch(groups, asked, top)
    return out
