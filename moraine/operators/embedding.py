"""Embedding of texts. The model is a plug-in; HashEmbedder needs none and is the same everywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.session import map_batches

QUERY, PASSAGE = "query: ", "passage: "


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed to signed buckets, damped by the root of their number, at length 1. A text without words is a zero vector."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words: dict[str, int] = {}
            for w in re.findall(r"\w+", t.lower()):
                words[w] = words.get(w, 0) + 1
            for w, n in words.items():
                h = xxhash.xxh64_intdigest(w)
                out[i, (h >> 1) % self.dim] += (1 if h & 1 else -1) * n**0.5
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embedded(rows: DataFrame, *, text_col: str = "text", vector_col: str = "embedding", prefix: str = PASSAGE, model: Embedder | None = None, batch: int = 256) -> DataFrame:
    """rows with the vector of each text, encoded in batches. A null text has a null vector. prefix: what the model wants before such texts."""
    model = model or HashEmbedder()
    names = [c for c in rows.columns if c.lower() != vector_col.lower()]
    schema = rows.select(*names).schema.add(vector_col, T.ArrayType(T.FloatType()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                texts = own.column(len(names)).to_pylist()
                x = model.encode([prefix + t if t is not None else "" for t in texts]).astype(np.float32)
                vectors = pa.array([None if t is None else v for t, v in zip(texts, x)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], vectors], names=schema.names)

    return map_batches(rows.select(*names, F.col(text_col).alias("_text")), run, schema)
