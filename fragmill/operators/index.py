"""The index of fragment instances: document frequencies, inverse frequencies and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: So many parts the rows of one key are cut into.
SALTS = 64


def with_idf(instances: DataFrame, term: str = "term") -> DataFrame:
    """instances with df and idf = ln(1 + N / df) of their term, over all instances, placeholders included.

    A merge join, as Spark may else take instances for small by their compressed size and send them all through the driver."""
    return share(instances, idf(instances, term), term)


def share(rows: DataFrame, shared: DataFrame, by: str) -> DataFrame:
    """rows with the columns of shared, which has one row a key; one key may have most of rows.

    The rows of a key are dealt to SALTS tasks by their hash, and what they share is sent to those that have some of them.  The rows
    are read twice."""
    own = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # a map has no hash
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(SALTS)))
    met = dealt.select(by, "_salt").distinct().join(shared.hint("merge"), by)
    return dealt.join(met.hint("merge"), [by, "_salt"]).drop("_salt")


def idf(instances: DataFrame, term: str = "term") -> DataFrame:
    """(term, df, idf): a map-side combined count, and the total as one broadcast row."""
    counts = instances.groupBy(term).agg(F.count("*").alias("df"))
    total = instances.agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).select(term, "df", F.log1p(F.col("_n") / F.col("df")).alias("idf"))


def with_vectors(instances: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each distinct text has one vector, which its instances share."""
    return instances.join(vectors, "text_hash")


def new_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Terms without a known vector, which have to be encoded."""
    return terms.join(known, "text_hash", "left_anti")


def all_vectors(terms: DataFrame, known: DataFrame, encoded: DataFrame) -> DataFrame:
    """Known vectors of terms that are still in use, and the new ones."""
    return known.join(terms.select("text_hash"), "text_hash", "left_semi").unionByName(encoded)
