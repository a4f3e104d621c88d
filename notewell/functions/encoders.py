"""Text encoders behind one interface: a Column function from text to a vector."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[Column], Column]
VECTOR = T.ArrayType(T.FloatType())


def batch_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Encoder:
    """An encoder around a model: `load` runs once per worker and returns a function from texts to rows of vectors."""

    @F.pandas_udf(VECTOR)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = np.asarray(model([t or "" for t in texts]), np.float32)
            yield pd.Series(list(rows), index=texts.index)

    return encode


def hashed_words(dimensions: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in where no neural model is at hand: signed hashed words and letter trigrams, unit length."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    padded = f"<{word}>"
                    for part in [word, *(padded[k : k + 3] for k in range(len(padded) - 2))]:
                        h = zlib.crc32(part.encode())
                        out[i, h % dimensions] += (1 if h & (1 << 20) else -1) * (3 if part is word else 1)
                size = np.linalg.norm(out[i])
                out[i] /= size or 1
            return out

        return encode

    return load
