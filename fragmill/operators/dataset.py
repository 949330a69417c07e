"""Assembly of a training set: texts of facets, attributed tags, hard negatives and generated queries, united and counted."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.exprs import bucket_of
from ..functions.tokens import content_tokens, tag_anchors
from ..sources.scratch import written
from ..sources.tables import query_pairs
from . import training

if TYPE_CHECKING:
    from ..sources.snapshot import SnapshotStore

AUGMENTATIONS = ("tag_pairs", "tag_descriptions", "llm_queries")
HELD_OUT = 15


def held_out(tag: Column) -> Column:
    """Whether a tag is kept for evaluation: 15 of 100 by a hash of its name."""
    return bucket_of("holdout", tag) < HELD_OUT


def paired(facets: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Elements of two arrays of a row side by side; the longer one is cut to the length of the shorter."""
    both = F.arrays_zip(F.slice(left, F.lit(1), F.least(F.size(left), F.size(right))), F.slice(right, F.lit(1), F.least(F.size(left), F.size(right))))
    return facets.select(*keys, F.posexplode(both).alias("place", "pair")).select(*keys, "place", F.col("pair")["0"].alias(left), F.col("pair")["1"].alias(right))


@dataclass
class TrainingSet:
    """pairs (kind, anchor, positive) with repetitions, triplets (tag, anchor, positive, negative), and one row of what they were
    made of."""

    pairs: DataFrame
    triplets: DataFrame
    sources: DataFrame

    def _counts(self) -> tuple[list[Column], list[Column]]:
        return [F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("kind") == "llm", 1)).alias("llm_pairs")], [F.count(F.lit(1)).alias("triplets")]

    @property
    def stats(self) -> DataFrame:
        """One row of counts, by aggregations of their own; a set that is written has them from its write."""
        pairs, triplets = self._counts()
        return self.sources.crossJoin(F.broadcast(self.pairs.agg(*pairs))).crossJoin(F.broadcast(self.triplets.agg(*triplets)))  # one row each

    def write(self, path: str) -> dict[str, int]:
        """Writes pairs, triplets and stats; the rows are counted as they are written, so that no plan runs twice for it."""
        found = {}
        for name, counts in zip(("pairs", "triplets"), self._counts(), strict=True):
            seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
            getattr(self, name).observe(seen, *counts).write.mode("overwrite").parquet(f"{path}/{name}")
            found |= seen.get
        self.sources.withColumns({n: F.lit(v).cast("bigint") for n, v in found.items()}).write.mode("overwrite").parquet(f"{path}/stats")
        return found


def assemble(
    texts: DataFrame, members: DataFrame, tags: DataFrame, cache: DataFrame | None = None, salt: str = "0", augment: Collection[str] = AUGMENTATIONS, p: training.Attribution = training.Attribution(),
    co_tag_sample: int | None = None,
) -> TrainingSet:
    """texts has entity, fragment, text_hash and text; members (tag, entity, pos); tags (tag, description); cache is that of the
    generated queries.  Tags that are held out take no part.  Hard negatives come from tags associated over all picks; with
    co_tag_sample only so many of a tag's first picks are counted for that."""
    unknown = set(augment) - set(AUGMENTATIONS)
    if unknown:
        raise ValueError(f"unknown augmentation {sorted(unknown)[0]!r}")
    own_tags, own = tags.where(~held_out(F.col("tag"))), members.where(~held_out(F.col("tag")))
    fragments = texts.select("entity", "fragment", content_tokens(F.col("text")).alias("tokens"))
    # a tag's picks stand in the order of its members: those with one fragment first
    chosen = training.attribute(fragments, own, own_tags, p).join(own, ["tag", "entity"]).join(texts, ["entity", "fragment"])
    picks = written(chosen.select("tag", F.struct("entity", "fragment").alias("entity"), "text", F.struct(F.col("margin").isNotNull().alias("late"), "pos", "fragment").alias("pos")), "picks")
    pairs = training.self_pairs(texts).select(F.lit("self").alias("kind"), "anchor", "positive")
    none = F.lit(None).cast("string")
    triplets = pairs.limit(0).select(none.alias("tag"), "anchor", "positive", none.alias("negative"))
    if "tag_pairs" in augment:
        found = training.tag_pairs(picks, "pos", f"{salt} pairs")
        pairs = pairs.unionAll(found.select(F.lit("tag"), "anchor", "positive"))
    if "tag_descriptions" in augment:
        anchors = own_tags.select("tag", F.explode(tag_anchors(F.col("tag"), F.col("description"))).alias("anchor"))
        pool = training.hard_negatives(picks, sample=co_tag_sample).join(picks.select("entity", "text").distinct(), "entity").select("tag", "text")
        rows = written(training.triplets(picks, pool, anchors, "pos", f"{salt} anchors"), "triplets")
        triplets = rows.where(F.col("negative").isNotNull())
        pairs = pairs.unionAll(rows.where(F.col("negative").isNull()).select(F.lit("anchor"), "anchor", "positive"))
    if "llm_queries" in augment and cache is not None:
        found = query_pairs(texts.select("text_hash", "text").distinct(), cache)
        pairs = pairs.unionAll(found.select(F.lit("llm"), F.col("query"), "text"))
    counts = [
        texts.agg(F.count("*").alias("fragments"), F.countDistinct("text").alias("texts")), own_tags.agg(F.count("*").alias("train_tags")),
        picks.agg(F.countDistinct("tag").alias("attributed_tags")),
    ]
    sources = counts[0]
    for one in counts[1:]:
        sources = sources.crossJoin(F.broadcast(one))  # one row each
    return TrainingSet(pairs, triplets, sources)


def run_stages(stages: list[tuple[str, Callable[[], object]]], store: SnapshotStore | None = None, run: str = "run") -> list[str]:
    """Runs (name, function) stages in order and stops at the first that fails, whose error names it; gives the names that are done.

    With a store, runs/<run>.json says after every stage what is done, and a run of that name goes on behind it."""
    at = f"runs/{run}.json"
    done: list[str] = list((store.read_json(at) or {}).get("done", ())) if store else []
    if done != [name for name, _ in stages][: len(done)]:
        raise ValueError(f"run {run!r} has done {', '.join(done)}, which aren't the first of these stages")
    for name, stage in stages[len(done) :]:
        try:
            stage()
        except Exception as e:
            raise RuntimeError(f"stage {name!r} failed after {', '.join(done) or 'none'}") from e
        done.append(name)
        if store:
            store.write_json(at, {"done": done})
    return done
