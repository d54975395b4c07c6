"""Embedding providers: each adds an ``embedding`` to rows of text."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwick.schemas import Config


#: Texts that are embedded at a time, words whose buckets are remembered, and the letters of the longest of them.
SLICE, WORDS, LETTERS = 512, 200_000, 32


class _Buckets(dict):
    """The bucket of any word; some are remembered, so that a worker's memory does not grow with the texts or with one of them."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: bytes) -> int:
        got = int.from_bytes(hashlib.md5(token).digest()[:2]) % self.dimensions
        if len(token) <= LETTERS:
            if len(self) >= WORDS:
                self.clear()
            self[token] = got
        return got

    def __reduce__(self):
        return _Buckets, (self.dimensions,)


#: Letters a to z and digits stay, every other byte becomes a space.
_SPACES = bytes(c if chr(c) in string.ascii_lowercase + string.digits else 32 for c in range(256))


class HashingEmbedder:
    """Counts of hashed words: plumbing that needs no model and that SQL can repeat."""

    name = "hashing"

    def __init__(self, dimensions: int = 1024):
        self.dimensions = dimensions
        self._buckets = _Buckets(dimensions)

    def bucket(self, token: str) -> int:
        return self._buckets[token.encode()]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in zip(out, texts):
            tokens = (text or "").lower().encode("ascii", "replace").translate(_SPACES).split()
            if tokens:
                row += np.bincount(np.fromiter(map(self._buckets.__getitem__, tokens), np.int64, len(tokens)), minlength=self.dimensions)
        return out


class ModelEmbedder:
    """Any model behind the same interface; ``load`` runs once in each Python worker."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
        self.name, self.load, self.batch, self._model = name, load, batch, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            self._model = self.load()
        parts = [np.asarray(self._model(texts[i : i + self.batch]), dtype=np.float32) for i in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)


def sentence_model(name: str) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A loader of a sentence model by name, where its library is installed."""

    def load():
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name).encode

    return load


def embedder_of(config: Config):
    """The embedding provider that a configuration names."""
    return HashingEmbedder(config.dimensions) if config.embedder == "hashing" else ModelEmbedder(config.embedder, sentence_model(config.embedder))


def embed(rows: DataFrame, embedder, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``embedding`` (float, length one, zero vectors as they are) of each row's text."""
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # a worker holds a batch and what is made of a slice
                part = batch.slice(at, SLICE)
                v = embedder.encode([t or "" for t in part.column(text).to_pylist()]).astype(np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                flat = (v / np.where(n > 0, n, 1)).astype(np.float32).ravel()
                ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(ends, flat)], names=[*keep, "embedding"])

    return rows.select(*keep, *[text] * (text not in keep)).mapInArrow(run, schema)
