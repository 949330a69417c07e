"""The request surface: similar facets by query or by seed, names, single entities and samples, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import bit_set, collapse_spaces, let
from ..functions.normalize import EMPTY, normalize, self_reference
from ..functions.segment import sources
from . import filters as request
from .encode import Encoder
from .names import NameIndex, search_names
from .score import Seed, score, score_distinct, seed_of_facet, top_hits
from .sequences import sample

if TYPE_CHECKING:
    from ..sources.snapshot import SnapshotStore

#: Fixed values.
CATEGORY_CODES = {"c": "creature", "i": "instant", "s": "sorcery", "e": "enchantment", "a": "artifact", "p": "planeswalker", "l": "land"}
FORMAT_CODES = {"s": "standard", "p": "pioneer", "m": "modern", "l": "legacy", "v": "vintage", "c": "commander", "u": "pauper"}
RARITY_CODES = {"c": "common", "u": "uncommon", "r": "rare", "m": "mythic"}
QUERY_TYPE_LINES = ["Creature", "Land", "Artifact", "Planeswalker", "Enchantment", "Instant", ""]
SELF_MARK = "qjqjq"  # letters of no word that normalization writes
DOUBLE_SIDED = ["transform", "modal_dfc", "meld", "double_faced_token", "art_series"]
ABILITY_WORD = r"(?m)^\s*([A-Za-z][A-Za-z' -]{1,40}?)\s+[—-]\s+"
KEYS = ["entity_id", "facet_ix"]
HIT_COLUMNS = ["entity_id", "record_id", "facet_ix", "image_side", "name", "entity_name", "similarity", "matched", "rank", "type_line", "mana_cost", "text", "power", "toughness", "colors", "layout", "rarity", "legalities", "border_color", "set_code"]


def image_side(layout: Column, facet_ix: Column) -> Column:
    """back for the later facets of a double-sided layout."""
    return F.when(layout.isin(DOUBLE_SIDED) & (facet_ix > 0), "back").otherwise("front")


def variants(source: Column) -> Column:
    """A fragment normalized under each of QUERY_TYPE_LINES.

    These differ in the self-reference alone, so the fragment is normalized once with a mark in its place, which no step reads or makes;
    only a fragment that has the mark's letters itself is normalized under each."""
    mark, name = F.lit(SELF_MARK), F.lit("")
    phrases = F.array(*(self_reference(F.lit(t)) for t in QUERY_TYPE_LINES))
    once = let(normalize(source, name, name, phrase=mark), lambda n: F.transform(phrases, lambda p: F.replace(n, mark, p)))
    each = F.transform(F.lit(QUERY_TYPE_LINES), lambda t: normalize(source, name, t))
    # apostrophes are dropped and symbols lower-cased on the way
    return F.when(F.lower(F.replace(source, F.lit("'"), F.lit(""))).contains(SELF_MARK), each).otherwise(once)


def query_parts(query: Column, keywords: Iterable[str], templates: Mapping[str, str]) -> Column:
    """array<struct<display, variants>> of queries: the fragments whose plain variant isn't empty, the first of each list of
    variants."""
    pieces = sources(F.regexp_replace(query, r"\s*//\s*", "\n"), keywords, templates)
    parts = F.transform(pieces, lambda s: F.struct(s["display"].alias("display"), F.array_distinct(variants(s["source"])).alias("variants")))

    def distinct(said: Column) -> Column:
        lists = F.transform(said, lambda p: p["variants"])
        return F.filter(said, lambda p, k: F.array_position(lists, p["variants"]) == k + 1)

    return let(F.filter(parts, lambda p: p["variants"][0] != EMPTY), distinct)


def query_fragments(spark: SparkSession, query: str | None, keywords: Iterable[str], templates: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """(display, variants) of each fragment of a query.  A query has no type line, so a fragment is normalized under each kind
    of self-reference, and its distinct variants are kept; a query is one short text, so this is one small row."""
    found = spark.range(1).select(query_parts(F.lit(query or ""), keywords, templates).alias("parts")).first()["parts"]
    return [(part["display"], part["variants"]) for part in found]


class Engine:
    """Serves one snapshot.  facets and entities are the built tables; instances has KEYS, fragment_ix, text, idf and either a
    vector, or text_hash where vectors (text_hash, vector) holds each distinct one once, which is then compared once.
    name_index is optional; without it names are found by a scan."""

    def __init__(
        self, entities: DataFrame, facets: DataFrame, instances: DataFrame, encoder: Encoder, keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None,
        vectors: DataFrame | None = None, name_index: NameIndex | None = None,
    ):
        self.spark, self.instances, self.encoder, self.vectors, self.name_index = instances.sparkSession, instances, encoder, vectors, name_index
        self.keywords, self.templates, self.entities = frozenset(keywords), templates or {}, entities
        own = entities.select("entity_id", "record_id", F.col("name").alias("entity_name"), "layout", "rank", "rarity", "legalities", "border_color", "set_code", "identity", F.col("cmc").alias("cmc"))
        masks = {"identity_mask": bit_set(F.split(F.coalesce("identity", F.lit("")), ""), request.COLORS), "color_mask": bit_set(F.col("colors"), request.COLORS)}
        # tables of the corpus meet by merge joins: a compressed size can look small enough to be sent through the driver
        self.facets = facets.join(own.hint("merge"), "entity_id").withColumns(masks).withColumn("image_side", image_side(F.col("layout"), F.col("facet_ix")))

    @classmethod
    def of_snapshot(cls, store: SnapshotStore, encoder: Encoder, keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None, snapshot: str | None = None, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> Engine:
        """Serves the tables entities, facets, fragments (with idf) and vectors of a snapshot, the live one by default, and its name
        index where it has one; kept is applied to each table, as to cache it."""

        def table(name: str) -> DataFrame:
            return kept(store.table(name, snapshot))

        entities, facets, instances, vectors = map(table, ("entities", "facets", "fragments", "vectors"))
        index = NameIndex(table("name_grams"), table("name_counts"), KEYS) if store.has("name_grams", snapshot) else None
        return cls(entities, facets, instances, encoder, keywords, templates, vectors, index)

    def _hits(self, seed: Seed | None, wanted: request.Filters, limit: int, offset: int, without: Column | None = None) -> DataFrame:
        alive = self.facets.where(wanted.predicate())
        alive = alive if without is None else alive.where(~without)
        if seed is None:
            return self.facets.limit(0).withColumns({"similarity": F.lit(0.0), "matched": F.lit("")}).select(*HIT_COLUMNS)
        # the filter is put below the scoring; idf was computed over the whole corpus
        if self.vectors is not None:
            scored = score_distinct(self.instances, self.vectors, seed, KEYS, alive=alive)
        else:
            scored = score(self.instances.join(alive.select(*KEYS), KEYS, "left_semi"), seed, KEYS)
        hits = top_hits(scored.join(alive.hint("merge"), KEYS), KEYS, limit, offset)
        return hits.select(*(c for c in HIT_COLUMNS if c not in ("similarity", "matched")), F.round("score", 6).alias("similarity"), F.col("display").alias("matched")).select(*HIT_COLUMNS)

    def search(self, query: str, wanted: request.Filters | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """Facets that have fragments like each of the query's."""
        parts = query_fragments(self.spark, query, self.keywords, self.templates)
        request.check_request(query, None, limit, offset, len(parts))
        texts = sorted({v for _, variants in parts for v in variants})
        rows = self.spark.createDataFrame([(t, t) for t in texts], "text_hash string, normalized string") if texts else None
        vectors = {r["text_hash"]: r["vector"] for r in self.encoder.encode(rows).collect()} if texts else {}
        seed = Seed([[vectors[v] for v in variants] for _, variants in parts]) if parts else None
        return self._hits(seed, wanted or request.Filters(), limit, offset)

    def similar(self, entity_id: str, facet_ix: int = 0, include: Iterable[int] = (), exclude: Iterable[int] = (), wanted: request.Filters | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """Facets whose fragments are like the given facet's; unknown facets have none."""
        request.check_request(None, entity_id, limit, offset)
        own = (F.col("entity_id") == entity_id) & (F.col("facet_ix") == facet_ix)
        seed = seed_of_facet(self.instances, own, tuple(include), tuple(exclude), self.vectors)
        return self._hits(seed, wanted or request.Filters(), limit, offset, own)

    def names(self, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
        among = self.facets if self.name_index is None else self.name_index.candidates(self.facets, query)
        found = search_names(among, query, limit, offset, ties=("facet_ix", "entity_id"))
        return found.select("name", "entity_name", F.lit(1.0).alias("similarity"), "rank", "entity_id", "record_id", "facet_ix", "image_side")

    def entity(self, entity_id: str) -> DataFrame:
        """The entity with its facets; KeyError if there is none."""
        found = self.entities.where(F.col("entity_id") == entity_id).limit(1)
        if found.isEmpty():
            raise KeyError(entity_id)
        return found.join(self.facets.select("entity_id", F.struct("facet_ix", "name", "type_line", "text").alias("f")).groupBy("entity_id").agg(F.array_sort(F.collect_list("f")).alias("facets")), "entity_id", "left")

    def sample_texts(self, n: int, salt: str) -> DataFrame:
        return sample(self.facets.where(F.coalesce("text", F.lit("")) != "").select(*KEYS, "text"), n, salt, *KEYS)

    def sample_terms(self, n: int, salt: str, pool: int = 300) -> DataFrame:
        """Keywords and ability words of a sample, distinct but for case."""
        words = self.sample_texts(pool, salt).select(F.explode(F.regexp_extract_all("text", F.lit(ABILITY_WORD), F.lit(1))).alias("term"))
        keywords = sample(self.entities.where(F.size("keywords") > 0), pool, salt, "entity_id").select(F.explode("keywords").alias("term"))
        tidy = keywords.unionByName(words).select(F.regexp_replace(collapse_spaces(F.col("term")), "^[ —-]+|[ —-]+$", "").alias("term")).where("term <> ''")
        return sample(tidy.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")), n, salt, "k").select("term")
