"""Running sums over sorted runs of a key that may stand in any number of partitions.

Rows are dealt by ranges of (key, order), so one key of any size is spread over several tasks. Each partition sums on its
own and ends with one row that says which key it broke off at; the sums to carry into later partitions follow from these
rows, one for each partition, and are added by a broadcast of as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, trimmed


@dataclass(frozen=True)
class Rolling:
    """Polynomial fingerprints: sums of value * base ** index, modulo a prime under 2 ** 31, one lane for each base."""

    prime: int = (1 << 31) - 1
    bases: tuple[int, ...] = (911_382_323, 972_663_749, 1_276_543_211, 1_603_875_691)

    def __post_init__(self) -> None:
        if len(self.bases) < 2 or not 2 < self.prime < 1 << 31:
            raise ValueError("two bases and a prime under 2 ** 31 are wanted")

    def power(self, n: int) -> list[int]:
        """Of each base; n may be negative."""
        return [pow(b, n, self.prime) for b in self.bases]

    def powers(self, n: int) -> np.ndarray:
        """Powers 0 to n - 1 of each base."""
        out = np.ones((len(self.bases), 1), np.int64)
        while out.shape[1] < n:
            step = np.array(self.power(out.shape[1]))[:, None]
            out = np.concatenate([out, out * step % self.prime], 1)
        return out[:, :n]


class _Runs:
    """Sums within runs of equal keys, over the batches of one partition."""

    def __init__(self, lanes: int, rolling: Rolling | None):
        self.rolling, self.table = rolling, np.ones((lanes, 0), np.int64)
        self.first: int | None = None
        self.key, self.count, self.sums = None, 0, np.zeros(lanes, np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each row within its key, sums up to it, and its own term of the sum."""
        n = len(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        index = np.arange(n) - starts[run]
        count, sums = (self.count, self.sums) if keys[0] == self.key else (0, np.zeros_like(self.sums))
        inside = run == 0
        if self.rolling:
            if self.table.shape[1] < n:
                self.table = self.rolling.powers(n)
            values = values * self.table[:, index] % self.rolling.prime
            if count:
                values[:, inside] = values[:, inside] * np.array(self.rolling.power(count))[:, None] % self.rolling.prime
        total = np.cumsum(values, axis=1)
        out = total - (total - values)[:, starts][:, run]
        out[:, inside] += sums[:, None]
        if self.rolling:
            out %= self.rolling.prime
        index[inside] += count
        if self.first is None:
            self.first = int(keys[0])
        self.key, self.count, self.sums = int(keys[-1]), int(index[-1]) + 1, out[:, -1]
        return index, out, values


def _scan(lanes: int, rolling: Rolling | None, schema: pa.Schema):
    """Rows of key, values and other columns to those of `schema`; the last row of a partition has `first` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, runs = TaskContext.get().partitionId(), _Runs(lanes, rolling)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).to_numpy()
            values = np.array([batch.column(1 + k).to_numpy() for k in range(lanes)], np.int64)
            index, sums, terms = runs.add(keys, values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.nulls(n, pa.int64()),
                    pa.array(index),
                    *map(pa.array, (*sums, *terms)),
                    batch.column(0),
                    *[batch.column(1 + lanes + k) for k in range(batch.num_columns - 1 - lanes)],
                ],
                schema=schema,
            )
        if runs.first is not None:
            numbers = [runs.count, *runs.sums.tolist(), *[0] * lanes, runs.key]
            head = [pa.array([part], pa.int32()), pa.array([runs.first]), *[pa.array([x], pa.int64()) for x in numbers]]
            yield pa.RecordBatch.from_arrays(head + [pa.nulls(1, schema.field(i).type) for i in range(len(head), len(schema))], schema=schema)

    return run


def carried(tails: Sequence[tuple[int, ...]], lanes: int, rolling: Rolling | None) -> list[tuple[int, ...]]:
    """What each partition's first key has before it: (part, key, count, sums, factors of the later sums).

    tails: (part, first key, last key, count and sums of the last key there) of each partition that has rows.
    """
    out: list[tuple[int, ...]] = []
    key, count, sums = None, 0, [0] * lanes
    for part, first, last, n, *own in sorted(tails):
        factors = rolling.power(count) if rolling else [1] * lanes
        if first == key:
            out.append((part, first, count, *sums, *factors))
        if first == last == key:
            joined = [s + f * o for s, f, o in zip(sums, factors, own)]
            count, sums = count + n, [x % rolling.prime for x in joined] if rolling else joined
        else:
            key, count, sums = last, n, own
    return out


def running(
    rows: DataFrame, key: str, order: Sequence[Column], values: Sequence[str], rolling: Rolling | None = None, ranges: Sequence[Column] | None = None
) -> DataFrame:
    """rows with `idx` (from 0 within the key), `sum0`... and `term0`... in place of the values.

    Sums run over all rows of the key up to and including this one, in the given order. key and values are longs without
    nulls; `ranges`, by default the order, deals rows to partitions and must agree with the order.
    """
    spark, lanes = rows.sparkSession, len(values)
    rest = [f for f in rows.schema.fields if f.name not in (key, *values)]
    names = [f"sum{k}" for k in range(lanes)] + [f"term{k}" for k in range(lanes)]
    numbers = [T.StructField(c, T.LongType()) for c in ("first", "idx", *names, key)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), *numbers, *[T.StructField(f.name, f.dataType) for f in rest]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, *values, *[f.name for f in rest]).repartitionByRange(parts, F.col(key), *(ranges or order))
    scanned = dealt.sortWithinPartitions(F.col(key), *order).mapInArrow(trimmed(_scan(lanes, rolling, arrow)), schema)
    scanned = materialize(scanned, "scan")
    tails = scanned.filter("first IS NOT NULL").select("part", "first", key, "idx", *names[:lanes])
    carry = carried([tuple(r) for r in tails.collect()], lanes, rolling)  # one row for each partition at most
    out = scanned.filter("first IS NULL").drop("first")
    if not carry:
        return out.drop("part")
    schema = ", ".join(["part int", f"{key} long", *[f"{c} long" for c in ("_n", *[f"_c{k}" for k in range(lanes)], *[f"_f{k}" for k in range(lanes)])]])
    out = out.join(F.broadcast(spark.createDataFrame(carry, schema)), ["part", key], "left")
    new = {"idx": F.col("idx") + F.coalesce("_n", F.lit(0))}
    for k in range(lanes):
        before, factor = F.coalesce(f"_c{k}", F.lit(0)), F.coalesce(f"_f{k}", F.lit(1))
        if rolling:
            new[f"term{k}"] = F.pmod(F.col(f"term{k}") * factor, F.lit(rolling.prime))
            new[f"sum{k}"] = F.pmod(before + F.pmod(F.col(f"sum{k}") * factor, F.lit(rolling.prime)), F.lit(rolling.prime))
        else:
            new[f"sum{k}"] = F.col(f"sum{k}") + before
    return out.withColumns(new).select("idx", *names, key, *[f.name for f in rest])
