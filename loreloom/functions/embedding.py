"""Text to vector.

The default embedder needs no weights: the JVM splits words, and one Arrow batch at a time its
distinct words are hashed to signed buckets and one bincount adds up all its vectors. A model
is plugged in with ``ModelEmbedder``.
"""

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.text import words
from loreloom.schemas import VECTOR


class Embedder(Protocol):
    dimensions: int

    def embed(self, text: Column) -> Column:
        """Unit-norm ``array<float>`` of ``dimensions`` entries."""


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, L2-normalised.

    Nine hex digits of the word's md5 give bucket and sign, so any SQL engine can
    reproduce the vector.
    """

    def __init__(self, dimensions: int = K.EMBEDDING_DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        dimensions = self.dimensions

        @F.arrow_udf(VECTOR)
        def accumulate(tokens: pa.Array) -> pa.Array:
            return _unit_vectors(tokens, dimensions)

        return F.when(text.isNotNull(), accumulate(words(F.lower(text))))


def _signed_bucket(word: str, dimensions: int) -> tuple[int, float]:
    value = int(hashlib.md5(word.encode()).hexdigest()[:9], 16)
    return value // 16 % dimensions, 1.0 if value % 16 < 8 else -1.0


def _unit_vectors(tokens: pa.Array, dimensions: int) -> pa.Array:
    rows = len(tokens)
    encoded = tokens.flatten().dictionary_encode()
    hashed = [_signed_bucket(word, dimensions) for word in encoded.dictionary.to_pylist()]
    bucket = np.array([b for b, _ in hashed], dtype=np.int64)
    sign = np.array([s for _, s in hashed], dtype=np.float64)
    word = encoded.indices.to_numpy(zero_copy_only=False)
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(rows, dtype=np.int64) * dimensions, lengths) + bucket[word]
    sums = np.bincount(cell, weights=sign[word], minlength=rows * dimensions).reshape(rows, dimensions)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    unit = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dimensions)
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))


class ModelEmbedder:
    """Wraps ``load() -> encode(list[str]) -> 2-d array``; loaded once per Python worker task."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]],
                 dimensions: int = K.EMBEDDING_DIMENSIONS):
        self.load = load
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        load, dimensions = self.load, self.dimensions

        @F.pandas_udf(VECTOR)
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                known = batch.notna()
                out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                if known.any():
                    vectors = np.asarray(model(batch[known].tolist()), dtype=np.float64)
                    if vectors.shape != (int(known.sum()), dimensions):
                        raise ValueError(f"expected {dimensions}-d vectors, got shape {vectors.shape}")
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
                    out[known] = pd.Series(list(unit.astype(np.float32)), index=batch.index[known])
                yield out

        return encode(text)
