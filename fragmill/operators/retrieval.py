"""Evaluation of a model by the search itself: query texts to fragments and variants, vectors, ranked facets, entities, figures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import written
from .batch import score_models
from .encode import Encoder
from .evaluate import comparison, metrics, summary
from .index import with_vectors
from .serve import query_parts

#: A fixed value: so many facets are ranked before they are reduced to entities.
RANKED_FACETS = 100
METRICS = ("mrr", "p_at_10", "recall_at_100")


def ranked_by_models(queries: DataFrame, models: Mapping[str, tuple[DataFrame, Encoder]], entities: DataFrame, keywords: Iterable[str], templates: Mapping[str, str]) -> DataFrame:
    """(model, query_id, entity_id, rank) of a search for each query text by each model, in one plan: queries are cut into fragments
    and variants once, and one pass of blocks scores them against all models' vectors.

    queries has query_id and query; models gives (instances, encoder) by name, where instances has entity_id, facet_ix and vector;
    entities has entity_id and rank."""
    asked = queries.select("query_id", F.posexplode(query_parts(F.col("query"), keywords, templates)).alias("fragment", "part"))
    asked = asked.select("query_id", "fragment", F.explode("part.variants").alias("normalized")).withColumn("text_hash", F.sha2("normalized", 256))
    asked = written(asked, "asked")  # each model's encoder reads it
    terms = asked.select("text_hash", "normalized").dropDuplicates(["text_hash"])
    facet = F.struct("entity_id", "facet_ix").alias("facet")
    known = said = facets = None
    for name, (instances, encoder) in models.items():
        label = F.lit(name).alias("model")
        own = instances.select(label, facet, F.col("vector").cast("array<double>").alias("vector"))
        one = with_vectors(asked, encoder.encode(terms)).select(label, "query_id", "fragment", F.col("vector").cast("array<double>").alias("vector"))
        every = instances.select("entity_id", "facet_ix")
        known, said, facets = (b if a is None else a.unionByName(b) for a, b in ((known, own), (said, one), (facets, every)))
    popularity = facets.distinct().join(entities.select("entity_id", F.col("rank").alias("popularity")), "entity_id", "left").select(facet, "popularity")
    hits = score_models(known, said, popularity, RANKED_FACETS)
    first = hits.groupBy("model", "query_id", F.col("facet.entity_id").alias("entity_id")).agg(F.min("rank").alias("_first"))
    place = F.row_number().over(Window.partitionBy("model", "query_id").orderBy("_first", "entity_id"))
    return first.withColumn("rank", place).drop("_first")


def metrics_by_models(queries: DataFrame, gold: DataFrame, models: Mapping[str, tuple[DataFrame, Encoder]], entities: DataFrame, keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None) -> DataFrame:
    """(model, query_id, kind, mrr, p_at_10, recall_at_100) of every query."""
    both = F.struct("model", "query_id").alias("query_id")
    ranked = ranked_by_models(queries, models, entities, frozenset(keywords), templates or {}).select(both, "entity_id", "rank")
    wanted = gold.withColumn("model", F.explode(F.array(*map(F.lit, models)))).select(both, "entity_id")
    rows = metrics(ranked, wanted).select("query_id.model", "query_id.query_id", "mrr", "p_at_10", "recall_at_100")
    return rows.join(queries.select("query_id", "kind"), "query_id").select("model", "query_id", "kind", "mrr", "p_at_10", "recall_at_100")


def differences(rows: DataFrame, candidate: str, served: str) -> DataFrame:
    """What the candidate gains on each query over the model that is served, from metrics_by_models."""
    a, b = (rows.where(F.col("model") == m).select("query_id", "kind", *(F.col(c).alias(f"{c}_{k}") for c in METRICS)) for k, m in (("a", candidate), ("b", served)))
    return a.join(b, ["query_id", "kind"]).select("query_id", "kind", *((F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in METRICS))


def evaluate_model(queries: DataFrame, gold: DataFrame, instances: DataFrame, entities: DataFrame, encoder: Encoder, keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None) -> DataFrame:
    """The figures of one model by kind of query and over all."""
    return summary(metrics_by_models(queries, gold, {"model": (instances, encoder)}, entities, keywords, templates).drop("model"))


def compare_models(queries: DataFrame, gold: DataFrame, models: Mapping[str, tuple[DataFrame, Encoder]], entities: DataFrame, keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None) -> DataFrame:
    """The figures of each model by kind of query and over all, as the candidate's beside those of the one served."""
    rows = written(metrics_by_models(queries, gold, models, entities, keywords, templates), "model-metrics")
    return comparison({name: summary(rows.where(F.col("model") == name).drop("model")) for name in models})
