"""Round trips through the sources and sinks: what is read back from the shared folder is what SQL says of the tables written."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dataset import assemble
from ..operators.encode import HashingEncoder
from ..operators.serve import ABILITY_WORD, image_side
from ..sources.scratch import new_path
from ..sources.lines import numbered, read_lines
from ..sources.snapshot import SnapshotStore
from ..sources.tables import read_query_cache, read_records, read_tags, recover_queries, write_query_cache
from ..streaming.batch_log import BatchLog
from ..streaming.refresh import VECTORS, read_vectors, stream_new_vectors
from .catalog import query, table
from .texts import raw_records


@query(
    """SELECT CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS oracle_id, 'r' || min(p_partkey) AS first, 'r' || max(p_partkey) AS last, count(*) AS n, sum((p_partkey % 5 = 0)::INTEGER * 2)::BIGINT AS faces
FROM part GROUP BY ALL"""
)
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as gzipped JSON lines in several files, read with the fixed schema: the first and the last of each entity in the
    order of file and line."""
    path = new_path(spark, "records")
    rows = raw_records(spark, sf_dir).drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice", "ordinal")
    rows.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.option("compression", "gzip").json(path)
    faces = F.greatest(F.coalesce(F.size("card_faces"), F.lit(0)), F.lit(0))
    ends = [F.min_by("id", "ordinal").alias("first"), F.max_by("id", "ordinal").alias("last")]
    return read_records(spark, path).groupBy("oracle_id").agg(*ends, F.count("*").alias("n"), F.sum(faces).alias("faces"))


@query(
    """WITH b AS (SELECT p_brand AS tag, p_type AS description, list(p_partkey ORDER BY p_partkey) AS ids, row_number() OVER (PARTITION BY p_brand ORDER BY p_type DESC) AS n FROM part GROUP BY p_brand, p_type)
SELECT tag, description, unnest(list_transform(ids, lambda i: 'e' || i)) AS entity, unnest(range(len(ids)))::INTEGER AS pos FROM b WHERE n = 1"""
)
def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of one tag the last counts."""
    path = new_path(spark, "tags")
    ids = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("oracle_id")))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label"), F.col("p_type").alias("description")).agg(ids.alias("taggings"))
    rows.repartitionByRange(3, "label").sortWithinPartitions("label", "description").write.option("compression", "gzip").json(path)
    tags, members = read_tags(spark, path)
    return tags.join(members, "tag").select("tag", "description", "entity", "pos")


@query("WITH x AS (SELECT sha256(text) AS hash, min(doc_id) AS doc_id, any_value(source) AS source FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT hash, 'find ' || doc_id AS queries, 'm' AS llm FROM x")
def query_cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "cache")
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    cache = texts.select(F.sha2("text", 256).alias("hash"), "text", F.array(F.concat(F.lit("find "), F.col("doc_id").cast("string"))).alias("queries"), F.lit("m").alias("llm"))
    write_query_cache(cache, path)
    return read_query_cache(spark, path).select("hash", F.array_join("queries", "|").alias("queries"), "llm")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS text FROM part) SELECT sha256(text) AS text_hash, text, 'b' AS state FROM n WHERE left(text, 1) > 'b'
UNION ALL SELECT sha256(text), text, 'a' FROM n WHERE left(text, 1) > 'b'"""
)
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots, of which the second is live: its table, and its vectors' terms, which are those still in use."""
    store, day = SnapshotStore(spark, new_path(spark, "snapshots")), datetime(2024, 1, 1, tzinfo=UTC)
    names = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("text_hash"), F.col("p_name").alias("normalized")).distinct()
    encoder, later = HashingEncoder(16), names.where("left(normalized, 1) > 'b'")
    store.publish({"terms": names}, names, encoder, "v1", day)
    store.publish({"terms": later}, later, encoder, "v2", day.replace(day=2))
    if store.publish({"terms": names}, names, encoder, "v2", day.replace(day=3)) is not None:
        raise AssertionError("an unchanged version was published again")
    live, _ = store.source("terms")
    vectors = store.table("vectors").join(names, "text_hash")
    return live.select("text_hash", F.col("normalized").alias("text"), F.lit("a").alias("state")).union(vectors.select("text_hash", F.col("normalized"), F.lit("b")))


@query(
    """SELECT kind, count(*) AS n FROM (SELECT DISTINCT o_orderpriority, 'self' AS kind FROM orders) GROUP BY kind
UNION ALL SELECT 'stats', count(*) FROM orders"""
)
def dataset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set of self-pairs alone, written and read back."""
    path = new_path(spark, "training-set")
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.lit(0).alias("fragment"), F.sha2("o_orderpriority", 256).alias("text_hash"), F.col("o_orderpriority").alias("text"))
    members = texts.select(F.lit("tag").alias("tag"), "entity", F.col("entity").alias("pos"))
    assemble(texts, members, members.select("tag", F.lit("").alias("description")).distinct(), augment=()).write(path)
    pairs, stats = spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/stats")
    return pairs.groupBy("kind").agg(F.count("*").alias("n")).unionByName(stats.select(F.lit("stats").alias("kind"), F.col("fragments").alias("n")))


@query(
    """WITH x AS (SELECT sha256(text) AS hash, min(doc_id) AS d FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT hash, 'find text ' || d || '|find more' AS queries FROM x WHERE d % 3 <> 0 UNION ALL SELECT hash, 'find text ' || d FROM x WHERE d % 3 = 0"""
)
def recovered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pairs whose anchor is neither a tag's nor a triplet's become cache rows; a one-word anchor is no query."""
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("d"))
    said = F.filter(F.array(F.concat(F.lit("Find text "), F.col("d").cast("string")), F.when(F.col("d") % 3 != 0, F.lit("find more.")), F.lit("known tag"), F.lit("of triplets"), F.lit("one")), lambda a: a.isNotNull())
    pairs = texts.select("text", F.posexplode(said).alias("pos", "anchor"))
    anchors, triplets = (spark.range(1).select(F.lit(x).alias("anchor")) for x in ("known tag", "of triplets"))
    return recover_queries(pairs, triplets, anchors, "m").select("hash", F.array_join("queries", "|").alias("queries"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 AND p_size % 2 = 1 THEN 'back' ELSE 'front' END AS side FROM part")
def image_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("layout", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'transform' WHEN 1 THEN 'modal_dfc' ELSE 'split' END"))
    return rows.select("p_partkey", image_side(F.col("layout"), F.col("p_size") % 2).alias("side"))


@query(
    """WITH w AS (SELECT p_partkey, [trim(p_type)] AS found FROM part WHERE p_size % 2 = 0)
SELECT p.p_partkey, coalesce(array_to_string(found, '|'), '') AS said FROM part p LEFT JOIN w USING (p_partkey)"""
)
def ability_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words before a dash at the beginning of a line, as they are harvested for samples."""
    text = F.concat(F.lit("2 x — no\n"), F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" — draw"))).otherwise(F.concat("p_type", F.lit(" draw"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.regexp_extract_all(text, F.lit(ABILITY_WORD), F.lit(1)), "|").alias("said"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS number, p_partkey || ' ' || p_name AS value FROM part")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file that is read in many parts, with their numbers in it."""
    path = new_path(spark, "lines")
    said = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name")
    table(spark, sf_dir, "part").repartition(1).sortWithinPartitions("p_partkey").select(said.alias("value")).write.text(path)
    return numbered(read_lines(spark, path, split=10_000)).select("number", "value")


@query("SELECT DISTINCT sha256(p_name) AS text_hash, 1 AS n FROM part")
def stream_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that come in two deliveries, the second with all of the first again, through the stream: one vector each, also after
    the batches were put together."""
    base, encoder = new_path(spark, "stream"), HashingEncoder(16)
    names = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("text_hash"), F.col("p_name").alias("normalized"), "p_partkey")
    for deliver in (names.where("p_partkey % 3 = 0"), names):
        deliver.drop("p_partkey").write.mode("append").parquet(f"{base}/in")
        stream_new_vectors(spark, f"{base}/in", f"{base}/out", f"{base}/state", encoder)
    BatchLog(spark, f"{base}/out", VECTORS).compact(model=encoder.name)
    return read_vectors(spark, f"{base}/out", encoder).groupBy("text_hash").agg(F.count("*").cast("int").alias("n"))
