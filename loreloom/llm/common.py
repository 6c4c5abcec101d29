"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.sources.tables import stored

__all__ = ["bounded_key", "column_or_null", "pieces_of", "remembered", "stored", "table", "text_batches", "word_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column_or_null(rows: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` cast to ``kind``; null where the table has none."""
    return (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast(kind)


def text_batches(batch, column: str, most_chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow batch in runs of about ``most_chars`` (one text at least), with the place of
    the first: Python objects of a whole batch are never alive at once. Null is ''."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, taken, size = 0, [], 0
    for i in range(batch.num_rows):
        text = texts[i].as_py() or ""
        taken.append(text)
        size += len(text)
        if size >= most_chars:
            yield start, taken
            start, taken, size = i + 1, [], 0
    if taken:
        yield start, taken


class remembered(dict):
    """A dict that computes missing values. It holds ``most`` of them, and as many older ones: when it is full, the
    values not asked for since it was last full are forgotten."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hash(word: str) -> int:
    """Unsigned 64 bits, the same in every process."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def pieces_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: each element's run, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - first[run]


def bounded_key(*columns: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))
