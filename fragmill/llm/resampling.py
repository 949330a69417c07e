"""Importance resampling towards a target distribution: hashed word runs, gains in an array, exact radix selection.

Features are hashed into a fixed number of buckets, so the statistics of corpus and target are two arrays whatever the corpus
holds: tasks count into an array of their own and pass on one row a bucket.  Logarithmic gains come back as one array, by
which a second scan scores every document.  Noise from a hash of the document's id turns the highest scores into a sample
without replacement.  The k-th key is found digit by digit: each pass counts 16 bits of the key among the rows that share the
digits so far, so at most 65,536 counts come to the driver and no sort of all documents is needed; only the rows at or before
the k-th key are sorted by range and numbered.

Edge cases: a null or empty text has no features, weighs 0 and isn't drawn; an empty target gives gains by the corpus alone;
a null doc_id hashes as empty text and comes last among equal scores; repeated rows are documents of their own, and rows with
equal score and doc_id are drawn in an order fixed when the scores are written; texts are read whole, in pieces of bounded
size; an empty table gives an empty result; other columns of the tables are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import by_bytes, discard, settle

#: Fixed by the definition of a word: digits, letters of ASCII in lower case, and every byte of other characters.
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Upper case to lower, word bytes as they are, all others to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))
PIECE = re.compile(rb".{1,1000000}[^ ]* *", re.DOTALL)
DIGIT = 16


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length."""
    for piece in PIECE.finditer(text.translate(FOLD)):
        yield piece.group().split()


def buckets_of(text: bytes, longest: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to longest words, and the number of words."""
    found, tail, n = [], [], 0
    for words in words_of(text):
        n += len(words)
        found.append(np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)))
        if longest > 1:
            words = tail + words
            for size in range(2, longest + 1):
                ends = range(max(size, len(tail) + 1), len(words) + 1)  # runs that end in this piece
                found.append(np.fromiter((crc32(b" ".join(words[e - size : e])) for e in ends), dtype=np.uint32, count=len(ends)))
            tail = words[-(longest - 1) :]
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)) % np.uint32(buckets), n


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def bucket_counts(table: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in by_bytes(batches, "text"):
            for text in _bytes_of(batch.column("text")):
                counts += np.bincount(buckets_of(text, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    found = table.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.collect():
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, with one added to every count."""
    whole, wanted = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(float(t + 1) * whole / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the document's id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document."""
    kinds = [pa.int64()] * 5
    names = ["doc_id", "n_features", "n_words", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, _bytes_of(batch.column("text")), strict=True):
                found, n_words = buckets_of(text, longest, len(gain))
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((doc_id, len(found), n_words, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def up_to_kth(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """The condition that holds for the first k rows in the order of the keys (whole numbers; together unique), by radix selection.

    Key by key and from its highest digit on, one pass counts the digits of the rows that agree in all digits before; the digit in
    which the k-th row lies is fixed, and what lies before it is subtracted from k.  It ends as soon as all rows that agree belong."""
    taken, same = F.lit(False), F.lit(True)  # rows before the prefix; rows that share it
    for key in keys:
        left = rows.where(same)
        low, high = left.agg(F.min(key), F.max(key)).first()
        if low is None or k <= 0:
            return taken
        # from the least value on, or with the sign flipped where that would leave 64 bits
        place = key - F.lit(low) if high - low < 2**63 else key.bitwiseXOR(F.lit(-(2**63)))
        bits = (high - low).bit_length() if high - low < 2**63 else 64
        for shift in range(max(0, -(-bits // DIGIT) - 1) * DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned(place, shift).bitwiseAND(F.lit(2**DIGIT - 1))
            for value, n in sorted(rows.where(same).groupBy(digit.alias("digit")).count().collect()):
                if k <= n:
                    break
                k -= n
            taken = taken | (same & (digit < value))
            same = same & (digit == value)
            if k == n:
                return taken | same
    raise ValueError("the keys don't tell all rows apart")


def ranked(rows: DataFrame, keys: list[Column], name: str = "rank", rows_a_part: int = 1_000_000) -> DataFrame:
    """rows with their place (from 1) in the order of the keys: sorted by ranges, numbered by part and place in the part."""
    parts = -(-rows.count() // rows_a_part) + 8
    at = F.monotonically_increasing_id()  # by its contract the part above 33 bits of the row's place in the part
    placed = settle(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at), "ranked")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    before, starts = 0, []
    for p, n in sorted(placed.groupBy(part.alias("part")).count().collect()):  # one row a part
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    all_docs = settle(scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = all_docs.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & up_to_kth(able, keys, k)
    chosen = ranked(all_docs.where(drawn), keys)
    out = all_docs.where(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(chosen)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
