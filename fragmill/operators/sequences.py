"""Ordered neighbours: islands of equal values, attachment to the line before, adjacent pairs, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers runs of equal neighbouring values from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(F.struct(value)).over(w) == F.struct(value), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def attach_to_previous(df: DataFrame, keys: Sequence[str], order: str, follows: Column, text: str, name: str = "block") -> DataFrame:
    """Joins lines for which follows holds to the line before them that doesn't follow, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    grouped = df.withColumn(name, F.sum(F.when(follows, 0).otherwise(1)).over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return grouped.groupBy(*keys, name).agg(F.array_join(lines, "\n").alias(text), F.count("*").alias("n_lines"))


def hash_order(salt: str, *columns: str) -> Column:
    """A fixed shuffle: the order of SHA-256 of the columns as text."""
    return F.sha2(F.concat_ws(":", F.lit(salt), *(F.col(c).cast("string") for c in columns)), 256)


def sample(df: DataFrame, n: int, salt: str, *columns: str) -> DataFrame:
    """n rows, the same for the same salt."""
    return df.orderBy(hash_order(salt, *columns), *columns).limit(n)


def adjacent_pairs(df: DataFrame, keys: Sequence[str], shuffle: Column, value: str, limit: int) -> DataFrame:
    """The shuffled rows of a group in pairs: first and second, third and fourth ...; an odd one is left over, and at most
    limit pairs of a group are taken."""
    w = Window.partitionBy(*keys).orderBy(shuffle, value)
    numbered = df.withColumn("_n", F.row_number().over(w)).withColumn("right", F.lead(value).over(w))
    kept = (F.col("_n") % 2 == 1) & (F.col("_n") <= 2 * limit) & F.col("right").isNotNull()
    return numbered.where(kept).withColumnRenamed(value, "left").drop("_n")
