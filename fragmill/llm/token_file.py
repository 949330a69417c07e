"""Token-id output: Parquet files with one list column of ids per document, in ascending doc_id order.

The id lists are written dictionary-free with the second data page version, so that they are delta-encoded; the metadata
columns keep dictionary or delta encoding.  Row groups and pages have set sizes, and each file carries the page indexes, so
a reader can fetch the metadata columns alone or the token pages of a doc_id range alone.

Files are ranges of doc_id, so file k holds smaller ids than file k + 1, and a row's place among all ids is its file's offset
(a sum over the metadata of earlier files) plus its place in the file, which the row carries.

Edge cases: a null text counts as empty and has the end id only; null doc_ids come first; rows with equal doc_id are kept, in
the order of a hash of their text, so that a doc_id with very many rows is cut too; an empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import by_bytes

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encoder_for(path: str) -> Callable[[list[str]], list[bytes]]:
    """The library encoder that suits the tokenizer file."""
    from .token_memo import byte_level_library, word_library

    return (word_library if "word_" in path.rpartition("/")[2] else byte_level_library)(path).encode


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, rows_per_file: int = 20_000, text_bytes_per_file: int = 100_000_000, row_group_bytes: int = 16_000_000, page_bytes: int = 256_000
) -> None:
    """Encodes every text with the tokenizer file, appends end_id, and writes the files below path, as many as keep both the
    rows and the text of a file few."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_files = max(1, round(rows / rows_per_file), round(size / text_bytes_per_file))
    keyed = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(n_files, "doc_id", "tie")
    ordered = keyed.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, starts = encoder_for(tokenizer), {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in by_bytes(batches, "text"):
            ids = [x + end for x in encode_texts(batch.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            parts, local = batch.column("part").to_numpy(), np.zeros(len(ids), dtype=np.int64)
            for k, n in enumerate(sizes):
                local[k] = starts.get(parts[k], 0)
                starts[parts[k]] = local[k] + n
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").view("<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(local), pa.array(sizes), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])

    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", "false")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.column.index.truncate.length", 64)
        .parquet(path)
    )


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids in all earlier files; one row per file, from two metadata columns."""
    totals = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start, the number of ids of all documents before them."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.join(file_offsets(spark, path), "part").withColumn("start", F.col("before") + F.col("local_start"))


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.  The ids are digested where they are read, so
    only a few numbers per document take part in the join with the files' offsets."""
    names = ["doc_id", "part", "local_start", "n_tokens"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select(*names, "ids").mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    placed = rows.join(file_offsets(spark, path), "part")
    return placed.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
