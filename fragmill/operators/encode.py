"""Encoders from text to vector.  Anything with a method encode(terms) -> terms with a vector can take their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import let


class Encoder(Protocol):
    name: str

    def encode(self, terms: DataFrame) -> DataFrame:
        """(text_hash, vector) of terms with text_hash and normalized."""


class HashingEncoder:
    """Bag of words: counts of crc32(token) modulo the dimension, of unit length; native expressions only, of terms that are distinct."""

    def __init__(self, dimension: int = 512):
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def encode(self, terms: DataFrame) -> DataFrame:
        """Each row by itself, without a shuffle: a text's slots are sorted, and the length of a run is the count of its slot."""
        tokens = F.coalesce(F.regexp_extract_all(F.lower("normalized"), F.lit("[a-z]+"), F.lit(0)), F.array().cast("array<string>"))
        slots = F.array_sort(F.transform(tokens, lambda t: F.crc32(t.cast("binary")) % self.dimension))

        def counts(s: Column) -> Column:
            ends = F.filter(F.transform(s, lambda x, k: F.when((k + 1 == F.size(s)) | (F.get(s, k + 1) != x), k)), lambda k: k.isNotNull())
            return let(ends, lambda e: F.map_from_arrays(F.transform(e, lambda k: F.get(s, k)), F.transform(e, lambda k, j: (k - F.when(j > 0, F.get(e, j - 1)).otherwise(-1)).cast("bigint"))))

        def dense(m: Column) -> Column:
            total = F.sqrt(F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, n: a + n * n))
            norm = F.when(total > 0, total).otherwise(1.0)
            return let(norm, lambda z: F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda k: (F.coalesce(F.try_element_at(m, k.cast("bigint")), F.lit(0)) / z).cast("float")))

        return terms.select("text_hash", let(let(slots, counts), dense).alias("vector"))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors (array<array<double>>) whose mask is 1, at unit length, as a native expression."""
    none = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    held = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(held, none, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))

    def unit(mean: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
        return let(norm, lambda n: F.transform(mean, lambda x: x / n))

    return let(F.transform(total, lambda x: x / count), unit)


def token_model(tokenize: Callable[[list[str]], list[list[int]]], model: Callable[[np.ndarray, np.ndarray], np.ndarray], max_tokens: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A batch function for ArrowEncoder of a model that gives a vector for each token: texts are cut after max_tokens tokens and
    padded with zeros, and the vectors that the mask holds are averaged and brought to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        ids = [x[:max_tokens] for x in tokenize(texts)]
        mask = np.zeros((len(ids), max(map(len, ids), default=0) or 1), dtype=np.int64)
        padded = np.zeros_like(mask)
        for k, x in enumerate(ids):
            mask[k, : len(x)], padded[k, : len(x)] = 1, x
        weights = mask[:, :, None].astype(np.float32)
        mean = (np.asarray(model(padded, mask)) * weights).sum(1) / np.maximum(weights.sum(1), 1e-9)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)

    return encode


class ArrowEncoder:
    """A model applied to batches of texts in tasks, the texts sorted by length so that a batch needs little padding; texts of one
    length are dealt to several tasks by their hash."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list]], batch: int = 64):
        self.name, self.load, self.batch = name, load, batch

    def encode(self, terms: DataFrame) -> DataFrame:
        load, size = self.load, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    vectors = pa.array([list(map(float, v)) for v in model(part.column("normalized").to_pylist())], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([part.column("text_hash"), vectors], ["text_hash", "vector"])

        ordered = terms.select("text_hash", "normalized").repartitionByRange(F.length("normalized"), F.xxhash64("text_hash")).sortWithinPartitions(F.length("normalized"))
        return ordered.mapInArrow(run, "text_hash string, vector array<float>")
