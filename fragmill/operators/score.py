"""Set similarity of facets to a small seed of fragment vectors: IDF-weighted Chamfer means, rejection, display and top-k.

The seed is a few vectors (a request's, or one facet's), so it enters the plan as literals: every instance, or every distinct
vector, gets its similarities in one projection, and one aggregation per facet gives the whole score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.exprs import dot

#: Most vectors of a seed; more are refused, since a seed is part of the plan.
MAX_SEED = 256


@dataclass
class Seed:
    """Groups of variant vectors, one group per wanted fragment; weights None means all alike; rejected vectors; and whether
    the seed is a facet's whole set, which makes the score bidirectional."""

    groups: Sequence[Sequence[Sequence[float]]]
    weights: Sequence[float] | None = None
    rejected: Sequence[Sequence[float]] = field(default_factory=list)
    bidirectional: bool = False

    def __post_init__(self) -> None:
        if sum(map(len, self.groups)) + len(self.rejected) > MAX_SEED:
            raise ValueError(f"a seed holds at most {MAX_SEED} vectors")


def _vector(values: Sequence[float]) -> Column:
    return F.lit([float(x) for x in values])


def best_similarity(vector: Column, group: Sequence[Sequence[float]]) -> Column:
    """The vector's similarity to the best variant of a group."""
    sims = [dot(vector, _vector(v)) for v in group]
    return sims[0] if len(sims) == 1 else F.greatest(*sims)


def seed_of_facet(instances: DataFrame, facet: Column, include: Sequence[int] = (), exclude: Sequence[int] = (), vectors: DataFrame | None = None) -> Seed | None:
    """The seed for a facet's own fragments; instances has fragment_ix, idf and either vector or the text_hash of vectors.
    Excluded fragments are rejected, and exclude wins over include.  None if nothing is left to search for."""
    own = instances.where(facet)
    own = own if vectors is None else own.join(vectors, "text_hash")
    rows = own.select("fragment_ix", "idf", "vector").orderBy("fragment_ix").limit(MAX_SEED + 1).collect()
    n = len(rows)
    if n > MAX_SEED:
        raise ValueError(f"a seed holds at most {MAX_SEED} vectors, the facet has more fragments")
    rejected = sorted({i for i in exclude if 0 <= i < n})
    wanted = [i for i in (include or range(n)) if 0 <= i < n and i not in rejected]
    if not wanted:
        return None
    return Seed([[rows[i]["vector"]] for i in wanted], [rows[i]["idf"] for i in wanted], [rows[i]["vector"] for i in rejected], len(wanted) == n)


def _similar(seed: Seed, vector: Column) -> list[Column]:
    """One similarity a wanted fragment, and that to the rejected vectors."""
    return [best_similarity(vector, g).alias(f"_s{k}") for k, g in enumerate(seed.groups)] + ([best_similarity(vector, seed.rejected).alias("_rejected")] if seed.rejected else [])


def similarities(vectors: DataFrame, seed: Seed, by: str = "text_hash", counted: Observation | None = None) -> DataFrame:
    """The similarities of every distinct vector (by, vector) to the seed; counted gets their number as vectors."""
    rows = vectors.select(by, "vector")
    rows = rows.observe(counted, F.count(F.lit(1)).alias("vectors")) if counted else rows
    return rows.select(by, *_similar(seed, F.col("vector")))


def score(instances: DataFrame, seed: Seed, keys: Sequence[str], ignore: float = 0.70, drop: float = 0.90, margin: float = 0.05) -> DataFrame:
    """keys, score and display of every facet that isn't rejected; instances carry their vectors."""
    rows = instances.select(*keys, "fragment_ix", "idf", "text", *_similar(seed, F.col("vector")))
    return score_facets(rows, seed, keys, ignore, drop, margin)


def score_distinct(instances: DataFrame, vectors: DataFrame, seed: Seed, keys: Sequence[str], by: str = "text_hash", alive: DataFrame | None = None, counted: Observation | None = None, **bounds: float) -> DataFrame:
    """The same in two steps, where instances share vectors: each distinct vector is compared once, and what is joined to its
    instances are a few numbers instead of the vector.

    Tables that are bucketed by the same key join without a shuffle.  The distinct vectors' numbers are hashed and the instances stream
    past them, so that those of one text, however many, are never sorted in a task's memory; alive (keys) leaves out facets after that, on the keys by
    which they are then aggregated, so that the narrow rows are dealt out once."""
    rows = instances.select(by, *keys, "fragment_ix", "idf", "text").join(similarities(vectors, seed, by, counted).hint("shuffle_hash"), by)
    rows = rows if alive is None else rows.join(alive.select(*keys).hint("merge"), list(keys), "left_semi")
    return score_facets(rows, seed, keys, **bounds)


def score_facets(rows: DataFrame, seed: Seed, keys: Sequence[str], ignore: float = 0.70, drop: float = 0.90, margin: float = 0.05) -> DataFrame:
    """One aggregation a facet over instances with their similarities.

    forward is the mean over the seed of its best match on the facet, backward the IDF-weighted mean over the facet's
    fragments of their best match in the seed.  A facet's similarity to a rejected vector scales its score down from ignore
    on and drops it from drop on.  display is the most distinctive fragment among those within margin of the best one."""
    names = [f"_s{k}" for k in range(len(seed.groups))]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    rows = rows.withColumn("_best", best)
    aggregates = [F.max(n).alias(n) for n in names]
    aggregates += [
        (F.sum(F.col("_best") * F.col("idf")) / F.sum("idf")).alias("_backward"),
        F.collect_list(F.struct("_best", "idf", (-F.col("fragment_ix")).alias("place"), "text")).alias("_fragments"),
    ]
    if seed.rejected:
        aggregates.append(F.max("_rejected").alias("_rejected"))
    facets = rows.groupBy(*keys).agg(*aggregates)
    weights = list(seed.weights) if seed.weights is not None else [1.0] * len(names)
    forward = reduce(lambda a, b: a + b, (F.col(n) * F.lit(float(w)) for n, w in zip(names, weights, strict=True))) / F.lit(float(sum(weights)))
    total = (forward + F.col("_backward")) / 2 if seed.bidirectional else forward
    if seed.rejected:
        scale = F.least(F.greatest((F.col("_rejected") - ignore) / (drop - ignore), F.lit(0.0)), F.lit(1.0))
        total = total * (1 - scale)
        facets = facets.where(F.col("_rejected") < drop)
    top = F.array_max(F.transform("_fragments", lambda f: f["_best"]))
    near = F.filter("_fragments", lambda f: f["_best"] >= top - margin)
    shown = F.array_max(F.transform(near, lambda f: F.struct(f["idf"], f["place"], f["text"].alias("text"))))["text"]
    return facets.select(*keys, total.alias("score"), F.nullif(shown, F.lit("")).alias("display"))


def top_hits(scored: DataFrame, keys: Sequence[str], limit: int, offset: int = 0, rank: str = "rank") -> DataFrame:
    """The best hits in a total order: score at four places, then the rank (zero and null last), then the keys."""
    order = [F.desc(F.round("score", 4)), F.asc_nulls_last(F.nullif(F.col(rank), F.lit(0))), *keys]
    ordered = scored.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page(scored: DataFrame, keys: Sequence[str], limit: int, offset: int = 0, max_offset: int = 500) -> tuple[DataFrame, Column]:
    """limit + 1 hits from offset on, and the rule that says from their number whether there is another page."""
    return top_hits(scored, keys, limit + 1, offset), (F.count("*") > limit) & F.lit(offset + limit <= max_offset)
