"""Readers and writers of raw records, tags and generated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.tokens import query_lines
from .lines import read_json_lines

FACE = "name string, mana_cost string, type_line string, oracle_text string, power string, toughness string, loyalty string, defense string, colors array<string>, color_indicator array<string>, image_uris map<string,string>, artist string, flavor_text string, cmc double"


def _struct(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in fields.split(", ")))


RECORD = (
    "id string, oracle_id string, layout string, games array<string>, released_at string, collector_number string, arena_id long, multiverse_ids array<long>, mtgo_id long, "
    "tcgplayer_id long, cardmarket_id long, edhrec_rank int, rarity string, legalities map<string,string>, `set` string, border_color string, color_identity array<string>, "
    f"keywords array<string>, {FACE}, card_faces array<struct<{_struct(FACE)}>>"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzipped or not, with the fixed schema; ordinal sorts as file and line do and is the same in every scan."""
    return read_json_lines(spark, path, RECORD)


def read_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """tags (tag, description) and members (tag, entity, pos) of JSON lines; of a repeated label the last line counts."""
    rows = read_json_lines(spark, path, "label string, description string, taggings array<struct<oracle_id: string>>", "_at")
    last = rows.groupBy("label").agg(F.max(F.struct("_at", "description", "taggings")).alias("r")).select(F.col("label").alias("tag"), "r.description", "r.taggings")
    members = last.select("tag", F.posexplode("taggings").alias("pos", "t")).select("tag", F.col("t.oracle_id").alias("entity"), "pos")
    return last.select("tag", "description"), members


CACHE = "hash string, text string, queries array<string>, llm string"


def read_query_cache(spark: SparkSession, path: str) -> DataFrame:
    """Generated queries by text hash; the last row of a hash counts."""
    rows = read_json_lines(spark, path, CACHE, "_at")
    w = Window.partitionBy("hash").orderBy(F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def write_query_cache(cache: DataFrame, path: str) -> None:
    cache.select("hash", "text", "queries", "llm").orderBy("hash").write.mode("overwrite").option("compression", "gzip").json(path)


def query_pairs(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(query, text) of every cached query of the texts (text_hash, text)."""
    return texts.join(cache.select(F.col("hash").alias("text_hash"), "queries"), "text_hash").select(F.explode("queries").alias("query"), "text")


def recover_queries(pairs: DataFrame, triplets: DataFrame, anchors: DataFrame, llm: str) -> DataFrame:
    """Cache rows from old pairs (anchor, text, pos): those whose anchor is neither a tag's nor a triplet's, by text."""
    known = triplets.select("anchor").union(anchors.select("anchor")).distinct()
    own = pairs.join(known, "anchor", "left_anti").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", "anchor"))).alias("all"))
    queries = query_lines(F.array_join(F.transform("all", lambda x: x["anchor"]), "\n"))
    rows = own.select(F.sha2("text", 256).alias("hash"), "text", queries.alias("queries"), F.lit(llm).alias("llm"))
    return rows.where(F.size("queries") > 0)


def merge_cache(own: DataFrame, other: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cache with the rows of another one for those wanted texts (text_hash) that it lacks; where both have one, its own stays."""
    missing = other.join(own.select("hash"), "hash", "left_anti").join(wanted.select(F.col("text_hash").alias("hash")).distinct(), "hash", "left_semi")
    return own.unionByName(missing)


def to_generate(texts: DataFrame, cache: DataFrame, limit: int) -> DataFrame:
    """The first texts by hash that have no cached queries."""
    return texts.join(cache.select(F.col("hash").alias("text_hash")), "text_hash", "left_anti").orderBy("text_hash").limit(limit)
