"""Sliding-window rate limits over a table of requests (client, endpoint, ts)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_SECONDS = 3600
KEYS = ("client", "endpoint")


def window_counts(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Adds `earlier`, the requests of the same key in the window before each: an upper bound of those admitted."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = W.partitionBy(*KEYS).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("_us", micros).withColumn("earlier", F.count("*").over(frame) - 1).drop("_us")


def admit(stamps: list[int], most: int, window: int, held: deque | None = None) -> tuple[list[bool], deque]:
    """Decides on stamps in order; only admitted requests count against later ones."""
    held = deque() if held is None else held
    out = []
    for t in stamps:
        while held and t - held[0] >= window:
            held.popleft()
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def admitted(requests: DataFrame, most: int, seconds: int = WINDOW_SECONDS, order: str = "request_id") -> DataFrame:
    """Adds `allowed`: exact decisions per key, in the order of time and `order`.

    A key's requests stand side by side in the order of time, and one pass over them holds no more than the `most` times
    admitted last, however many requests the key has. Requests without a time are refused and do not count.
    """
    window = seconds * 1_000_000
    typed = requests.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    dealt = typed.repartition(*KEYS).sortWithinPartitions(*KEYS, "_us", order)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, deque()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS)))
            stamps, allowed = batch.column("_us").to_pylist(), []
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != key:
                    key, held = keys[start], deque()
                timed = [t for t in stamps[start:stop] if t is not None]
                found, held = admit(timed, most, window, held)
                allowed += [False] * (stop - start - len(timed)) + found  # those without a time stand first
                start = stop
            rest = batch.select([n for n in batch.schema.names if n != "_us"])
            yield rest.append_column("allowed", pa.array(allowed, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", allowed boolean"
    return dealt.mapInArrow(decide, schema)


def remaining(decided: DataFrame, now, most: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per key: how many requests are still admitted at `now`, a timestamp column or its text."""
    now = F.lit(now) if isinstance(now, str) else now
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    inside = F.col("allowed") & (age < seconds * 1_000_000) & (age >= 0)
    return decided.groupBy(*KEYS).agg(F.greatest(F.lit(0).cast("long"), most - F.count_if(inside)).alias("remaining"))


def reset(decided: DataFrame, client: str, endpoint: str | None = None) -> DataFrame:
    gone = F.col("client") == client
    return decided.filter(~(gone & (F.col("endpoint") == endpoint)) if endpoint else ~gone)
