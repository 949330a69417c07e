"""Reading of embedding columns: which vectors take part, and their numbers as bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def takes_part(vector: Column) -> Column:
    """True where the vector isn't null or empty and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
