"""Helpers of the training-data operators: tables in the shared folder that cut lineage, sortable keys, and Arrow slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import new_path, remove


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes settled tables that nothing will read again, because what was made of them is itself a written table."""
    for table in tables:
        if table is not None and hasattr(table, "settled_at"):
            remove(table.sparkSession, table.settled_at)


def order_key(*numbers: Column) -> Column:
    """Whole numbers as bytes that sort as the numbers do, null last: nine bytes each."""
    flipped = [F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0") for c in numbers]
    return F.unhex(F.concat(*(F.when(c.isNull(), "01" + "0" * 16).otherwise(F.concat(F.lit("00"), x)) for c, x in zip(numbers, flipped, strict=True))))


def number_at(key: Column, place: int) -> Column:
    """The number at a place of an order key."""
    part = F.hex(F.substring(key, 9 * place + 2, 8))
    value = F.conv(part, 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(key, 9 * place + 1, 1)) == "00", value)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices whose text column holds about limit bytes, so that long texts stay few at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)
