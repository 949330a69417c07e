"""Evaluation of rankings: reciprocal rank, precision at 10 and recall at 100, per kind of query and over all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tokens import spaced
from .dataset import held_out

#: Smaller tags give unstable figures, larger ones are no concept that a ranking could satisfy.
MIN_TAG_ENTITIES, MAX_TAG_ENTITIES = 20, 600


def entity_ranking(hits: DataFrame, query: str = "query_id", entity: str = "entity_id", rank: str = "rank") -> DataFrame:
    """Ranked facets to ranked entities: an entity stands where its first facet stood."""
    first = hits.groupBy(query, entity).agg(F.min(rank).alias("_first"))
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy("_first", entity))).drop("_first")


def metrics(ranked: DataFrame, gold: DataFrame, query: str = "query_id", entity: str = "entity_id") -> DataFrame:
    """query, mrr, p_at_10, recall_at_100 from rankings (query, entity, rank) and gold pairs (query, entity)."""
    sizes = gold.groupBy(query).agg(F.count("*").alias("n_gold"))
    hits = ranked.join(gold.select(query, entity, F.lit(True).alias("_hit")), [query, entity], "left")
    return _figures(sizes, hits, query)


def metrics_by_group(ranked: DataFrame, asked: DataFrame, members: DataFrame, query: str = "query_id", entity: str = "entity_id", group: str = "group") -> DataFrame:
    """metrics where queries share their gold: asked (query, group) says whose, and members (group, entity) what it is.  The pairs of
    queries and gold entities, which are as many as the square of a group, are never made."""
    members = members.select(group, entity).distinct()
    sizes = asked.join(members.groupBy(group).agg(F.count("*").alias("n_gold")), group).select(query, "n_gold")
    hits = ranked.join(asked.select(query, group), query, "left").join(members.withColumn("_hit", F.lit(True)), [group, entity], "left")
    return _figures(sizes, hits, query)


def _figures(sizes: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    found = hits.groupBy(query).agg(
        F.min(F.when(F.col("_hit"), F.col("rank"))).alias("first"),
        F.count(F.when(F.col("_hit") & (F.col("rank") <= 10), 1)).alias("in_10"),
        F.count(F.when(F.col("_hit") & (F.col("rank") <= 100), 1)).alias("in_100"),
    )
    return sizes.join(found, query, "left").select(
        query,
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("in_10", F.lit(0)) / 10.0).alias("p_at_10"),
        (F.coalesce("in_100", F.lit(0)) / F.least("n_gold", F.lit(100))).alias("recall_at_100"),
    )


def summary(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Means per kind and, with kind "all", over all queries."""
    means = [F.count("*").alias("queries"), *(F.round(F.avg(m), 4).alias(m) for m in ("mrr", "p_at_10", "recall_at_100"))]
    return rows.groupingSets([[kind], []], kind).agg(F.grouping(kind).alias("_all"), *means).withColumn(kind, F.when(F.col("_all") == 1, "all").otherwise(F.col(kind))).drop("_all")


def evaluation_queries(tags: DataFrame, members: DataFrame, known: DataFrame, paraphrases: DataFrame | None = None, low: int = MIN_TAG_ENTITIES, high: int = MAX_TAG_ENTITIES) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, kind, tag, query) of the held-out tags, and their gold (query_id, entity_id).

    tags has tag and description, members tag and entity, known entity_id, paraphrases phrase and tag.  Gold entities are those
    that are known; a tag with too few or too many of them asks nothing, and neither do paraphrases of other tags."""
    gold = members.where(held_out(F.col("tag"))).select("tag", F.col("entity").alias("entity_id")).distinct().join(known.select("entity_id").distinct(), "entity_id", "left_semi")
    sizes = gold.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    asked = tags.join(sizes.select("tag"), "tag", "left_semi").select("tag", spaced(F.col("tag")).alias("name"), "description")
    queries = asked.select("tag", F.lit("name").alias("kind"), F.col("name").alias("query"))
    described = asked.where(F.coalesce("description", F.lit("")) != "")
    queries = queries.unionByName(described.select("tag", F.lit("described").alias("kind"), F.concat("name", F.lit(". "), "description").alias("query")))
    if paraphrases is not None:
        queries = queries.unionByName(paraphrases.join(sizes.select("tag"), "tag", "left_semi").select("tag", F.lit("paraphrase").alias("kind"), F.col("phrase").alias("query")))
    queries = queries.select(F.sha2(F.concat_ws("\x01", "kind", "tag", "query"), 256).alias("query_id"), "kind", "tag", "query")
    return queries, queries.select("query_id", "tag").join(gold, "tag").select("query_id", "entity_id")


def comparison(results: Mapping[str, DataFrame]) -> DataFrame:
    """The summaries of several models, a row for each kind and model."""
    out = None
    for model, rows in results.items():
        named = rows.withColumn("model", F.lit(model))
        out = named if out is None else out.unionByName(named)
    return out
