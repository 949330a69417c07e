"""Name search: exact names, then prefixes, then names that contain the query; popularity breaks ties.

An inverted index from runs of one to three letters to names gives the few names that can contain a query, so that a search
reads the lists of its rarest runs instead of all names; the exact test follows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LONGEST_GRAM = 3


def search_names(facets: DataFrame, query: str, limit: int, offset: int = 0, name: str = "name", rank: str = "rank", ties: tuple[str, ...] = ()) -> DataFrame:
    """facets that match with match_class (0 exact, 1 prefix, 2 contains); a blank query matches nothing.  The query is plain
    text: it is compared, not used as a pattern."""
    wanted = query.strip().lower()
    lower = F.lower(F.col(name))
    kind = F.when(lower == wanted, 0).when(lower.startswith(wanted), 1).when(lower.contains(wanted), 2)
    found = facets.withColumn("match_class", kind).where(F.col("match_class").isNotNull() & F.lit(bool(wanted)))
    ordered = found.orderBy("match_class", F.asc_nulls_last(rank), name, *ties)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def grams(name: Column) -> Column:
    """The distinct runs of one to three letters of a name in lower case."""
    low, size = F.lower(name), F.length(F.lower(name))

    def of(n: int) -> Column:
        places = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.substring(low, k, F.lit(n)))

    return F.array_distinct(F.concat(*(of(n) for n in range(1, LONGEST_GRAM + 1))))


def wanted_grams(query: str) -> list[str]:
    """Runs that every name with the query has: of three letters, or the whole query where it is shorter."""
    q = query.strip().lower()
    return sorted({q[k : k + LONGEST_GRAM] for k in range(max(len(q) - LONGEST_GRAM + 1, 1))} - {""})


@dataclass
class NameIndex:
    """postings has gram and keys, a row a gram and name; counts (gram, n) says how many names have a gram.  Both are to be stored
    in the order of gram, so that a search reads only the parts with its own."""

    postings: DataFrame
    counts: DataFrame
    keys: Sequence[str]
    rarest: int = 3

    @classmethod
    def of(cls, names: DataFrame, keys: Sequence[str], name: str = "name") -> NameIndex:
        postings = names.select(F.explode(grams(F.col(name))).alias("gram"), *keys)
        return cls(postings, postings.groupBy("gram").agg(F.count("*").alias("n")), keys)

    def chosen(self, query: str) -> list[str] | None:
        """The rarest of the query's grams, of which a request has at most as many as letters; None if no name has one of them."""
        wanted = wanted_grams(query)
        known = self.counts.where(F.col("gram").isin(wanted)).collect() if wanted else []
        return [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[: self.rarest]] if len(known) == len(wanted) else None

    def candidates(self, names: DataFrame, query: str) -> DataFrame:
        """The rows of names that have the query's rarest grams: every name that contains the query, and few others."""
        chosen = self.chosen(query)
        if not chosen:
            return names.limit(0)
        rows = self.postings.where(F.col("gram").isin(chosen))
        if len(chosen) > 1:
            rows = rows.groupBy(*self.keys).agg(F.count("*").alias("_n")).where(F.col("_n") == len(chosen))
        return names.join(rows.select(*self.keys).hint("merge"), list(self.keys), "left_semi")
