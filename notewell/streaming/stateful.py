"""Streams: exact rate limits as keyed state, and an index that follows a stream of notes."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rate_limit import KEYS, WINDOW_SECONDS, admit


def admitted_stream(requests: DataFrame, most: int, seconds: int = WINDOW_SECONDS, forget: bool = False) -> DataFrame:
    """Decisions for a stream of (client, endpoint, ts, request_id): state per key is the admitted times in the window.

    At most `most` times are held per key. With `forget`, a key without requests for a window of processing time is
    dropped; that asks for a batch again and again, so it suits a continuous trigger and never ends an availableNow one.
    """
    window = seconds * 1_000_000

    def decide(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        held = deque(state.get[0]) if state.exists else deque()
        allowed, held = admit(rows["us"].tolist(), most, window, held)
        state.update((list(held),))
        if forget:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"client": key[0], "endpoint": key[1], "request_id": rows["request_id"].to_numpy(), "allowed": allowed})

    typed = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select(*KEYS, "us", "request_id")
    kinds = dict(typed.dtypes)
    shape = f"client {kinds['client']}, endpoint {kinds['endpoint']}, request_id {kinds['request_id']}, allowed boolean"
    return typed.groupBy(*KEYS).applyInPandasWithState(decide, shape, "held array<long>", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")


def follow(notes: DataFrame, merge_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Feeds each micro-batch of changed notes to merge_batch (a keyed merge that writes a new index version)."""
    writer = notes.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
