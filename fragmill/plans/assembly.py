"""Queries of evaluation by the search, of generated-query caches, of the sitemap and of the assembly of training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluate, training
from ..operators.batch import score_queries
from ..operators.dataset import TrainingSet, assemble, paired
from ..operators.index import all_vectors, new_terms
from ..sources.sitemap import sitemap
from ..sources.tables import merge_cache, query_pairs, to_generate
from .catalog import order_brands, query, table

# evaluation by the search: three fragments a query, the last with two variants


@query(
    """WITH e AS (SELECT vec_id // 5 AS facet, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT (vec_id // 50) * 50 AS query_id, least(vec_id % 50, 2) AS fragment, v FROM e WHERE vec_id % 50 < 4),
s AS (SELECT query_id, fragment, facet, max(list_inner_product(e.v, q.v)) AS sim FROM e, q GROUP BY ALL),
f AS (SELECT query_id, facet, avg(sim) AS score FROM s GROUP BY ALL),
r AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 10000 + 0.5) DESC, nullif(p_size % 7, 0) NULLS LAST, facet)::INTEGER AS rank FROM f JOIN part ON p_partkey = facet)
SELECT query_id, facet, round(score, 6) AS score, rank FROM r WHERE rank <= 20"""
)
def rank_fragment_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 < 4").select(F.expr("vec_id div 50 * 50").alias("query_id"), F.least(F.col("vec_id") % 50, F.lit(2)).alias("fragment"), F.col("embedding").alias("vector"))
    popularity = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("facet"), (F.col("p_size") % 7).alias("popularity"))
    known = e.select(F.expr("vec_id div 5").alias("facet"), F.col("embedding").alias("vector")).join(popularity.select("facet"), "facet", "left_semi")
    return score_queries(known, q, popularity, 20).withColumn("score", F.round("score", 6))


@query(
    """WITH h AS (SELECT DISTINCT p_brand AS tag, ('0x' || substr(sha256('holdout:' || p_brand), 1, 8))::BIGINT % 100 AS bucket FROM part),
g AS (SELECT DISTINCT p_brand AS tag, p_partkey AS entity FROM part JOIN h ON h.tag = p_brand AND bucket < 15 WHERE p_size > 3),
z AS (SELECT tag, count(*) AS n FROM g GROUP BY tag HAVING count(*) BETWEEN 20 AND 900),
q AS (SELECT tag, 'name' AS kind, tag AS query, n FROM z UNION ALL SELECT tag, 'described', tag || '. About ' || tag, n FROM z WHERE right(tag, 1) <> '4'
  UNION ALL SELECT tag, 'paraphrase', 'like ' || tag, n FROM z)
SELECT kind, tag, query, n AS n_gold FROM q"""
)
def evaluation_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_partkey").alias("entity"), "p_size")
    tags = parts.select("tag", F.when(~F.col("tag").endswith("4"), F.concat(F.lit("About "), "tag")).alias("description")).distinct()
    said = tags.select(F.concat(F.lit("like "), "tag").alias("phrase"), "tag")
    known = parts.where("p_size > 3").select(F.col("entity").alias("entity_id"))
    queries, gold = evaluate.evaluation_queries(tags, parts.select("tag", "entity"), known, said, high=900)
    return queries.join(gold.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id").select("kind", "tag", "query", "n_gold")


@query(
    """WITH h AS (SELECT vec_id % 50 AS query_id, vec_id // 50 AS rank, vec_id % 37 AS entity_id FROM embeddings),
f AS (SELECT query_id, entity_id, min(rank) AS first FROM h GROUP BY query_id, entity_id)
SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY first, entity_id)::INTEGER AS rank FROM f"""
)
def facets_to_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.expr("vec_id div 50").alias("rank"), (F.col("vec_id") % 37).alias("entity_id"))
    return evaluate.entity_ranking(hits)


# arrays side by side, caches, vectors


@query(
    """WITH f AS (SELECT c_custkey, c_name, c_nationkey % 4 AS n FROM customer)
SELECT c_custkey, unnest(range(least(3, n))) AS place, unnest(list_transform(range(least(3, n)), lambda i: c_name || i)) AS said, unnest(list_transform(range(least(3, n)), lambda i: i * 10)) AS hash FROM f WHERE n > 0"""
)
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of three and of zero to three elements side by side."""
    names = F.transform(F.lit([0, 1, 2]), lambda i: F.concat("c_name", i.cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", names.alias("said"), F.slice(F.lit([0, 10, 20]).cast("array<bigint>"), F.lit(1), (F.col("c_nationkey") % 4).cast("int")).alias("hash"))
    return paired(rows, ["c_custkey"], "said", "hash").withColumn("place", F.col("place").cast("bigint"))


def query_cache(spark: SparkSession, sf_dir: str, residue: int) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (text_hash, text) of documents, and a cache with queries for those whose first document leaves the residue."""
    documents = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("text IS NOT NULL")
    texts = documents.select(F.sha2("text", 256).alias("text_hash"), "text", "doc_id")
    queries = F.array(F.concat(F.lit("find "), F.col("doc_id").cast("string")), F.lit("find any"))
    return texts, texts.where(F.col("doc_id") % 3 == residue).select(F.col("text_hash").alias("hash"), "text", queries.alias("queries"), F.lit(f"llm {residue}").alias("llm"))


CACHED = "WITH x AS (SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) "


@query(CACHED + "SELECT 'find ' || doc_id AS query, text_hash FROM x WHERE doc_id % 3 = 0 UNION ALL SELECT 'find any', text_hash FROM x WHERE doc_id % 3 = 0")
def generated_query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cache = query_cache(spark, sf_dir, 0)
    return query_pairs(texts.select("text_hash", "text"), cache).select("query", F.sha2("text", 256).alias("text_hash"))


@query(CACHED + "SELECT text_hash FROM x WHERE doc_id % 3 <> 0 ORDER BY text_hash LIMIT 200")
def texts_to_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator's own: so many texts are generated for at most."""
    texts, cache = query_cache(spark, sf_dir, 0)
    return to_generate(texts, cache, 200).select("text_hash")


@query(CACHED + "SELECT text_hash AS hash, 'llm ' || (doc_id % 3) AS llm FROM x WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)")
def merged_query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cache = query_cache(spark, sf_dir, 0)
    other = query_cache(spark, sf_dir, 1)[1].unionByName(cache.withColumn("llm", F.lit("other")))
    return merge_cache(cache, other, texts.where("doc_id % 2 = 0")).select("hash", "llm")


@query(
    CACHED
    + """, n AS (SELECT text_hash FROM x WHERE doc_id % 2 = 1), k AS (SELECT text_hash FROM x WHERE doc_id % 3 = 0)
SELECT text_hash, 1 AS v FROM n WHERE text_hash NOT IN (SELECT text_hash FROM k) UNION ALL SELECT text_hash, 0 FROM k WHERE text_hash IN (SELECT text_hash FROM n)"""
)
def vectors_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only terms without a known vector are encoded (here: 1), and known vectors (0) stay for the terms still in use."""
    texts, _ = query_cache(spark, sf_dir, 0)
    terms, known = texts.where("doc_id % 2 = 1").select("text_hash"), texts.where("doc_id % 3 = 0").select("text_hash", F.lit(0).alias("v"))
    return all_vectors(terms, known, new_terms(terms, known).withColumn("v", F.lit(1)))


@query(
    """WITH d AS (SELECT doc_id % 7 AS tag, doc_id AS pos, doc_id // 2 AS entity, sha256(text) AS text FROM documents WHERE text IS NOT NULL)
SELECT tag, text, arg_min(entity, pos) AS entity FROM d GROUP BY tag, text"""
)
def distinct_tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 7).alias("tag"), F.col("doc_id").alias("pos"), F.expr("doc_id div 2").alias("entity"), F.sha2("text", 256).alias("text"))
    return training.distinct_texts(rows, "pos").select("tag", "text", "entity")


# sitemap


@query(
    """WITH i AS (SELECT DISTINCT c_name || '&<"' || c_nationkey AS id FROM customer ORDER BY id LIMIT 49999)
SELECT 3 AS part, id, '<url><loc>https://a.b/?entity=' || replace(replace(replace(id, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</loc><changefreq>weekly</changefreq><priority>0.7</priority></url>' AS line FROM i
UNION ALL SELECT * FROM (VALUES (0, '', '<?xml version="1.0" encoding="UTF-8"?>'), (1, '', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
(2, '', '<url><loc>https://a.b/</loc><lastmod>2024-05-06</lastmod><changefreq>daily</changefreq><priority>1.0</priority></url>'), (4, '', '</urlset>'))"""
)
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit('&<"'), F.col("c_nationkey").cast("string")).alias("entity_id"))
    return sitemap(ids, "https://a.b/", "2024-05-06T01:02:03Z")


# the assembly: brands as tags of orders, an order's text is its priority and price


ASSEMBLED = """
WITH m AS (SELECT DISTINCT p_brand AS tag, l_orderkey AS entity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE ('0x' || substr(sha256('holdout:' || p_brand), 1, 8))::BIGINT % 100 >= 15),
t AS (SELECT o_orderkey AS entity, o_orderpriority || ' ' || floor(o_totalprice / 5000)::BIGINT AS text FROM orders),
p AS (SELECT tag, entity, text FROM m JOIN t USING (entity)),
sz AS (SELECT tag AS other, count(*) AS size FROM p GROUP BY tag),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY entity) AS n FROM p){first}),
o AS (SELECT f.tag, p.tag AS other, count(*) AS n FROM f JOIN p USING (entity) WHERE f.tag <> p.tag GROUP BY f.tag, p.tag HAVING count(*) >= 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n / size DESC, other DESC) AS place FROM o JOIN sz USING (other)) WHERE place <= 12),
c AS (SELECT top.tag, p.entity, min((place, p.entity)) AS spot FROM top JOIN p ON p.tag = top.other WHERE NOT EXISTS (SELECT 1 FROM p own WHERE own.tag = top.tag AND own.entity = p.entity) GROUP BY top.tag, p.entity),
pool AS (SELECT DISTINCT tag, text FROM (SELECT tag, entity, row_number() OVER (PARTITION BY tag ORDER BY spot, entity) AS n FROM c) JOIN t USING (entity) WHERE n <= 2000),
d AS (SELECT tag, text, min(entity) AS entity FROM p GROUP BY tag, text),
a AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sha256('s pairs:' || tag || ':' || text), entity, text) AS n FROM d),
tp AS (SELECT x.text AS anchor, y.text AS positive FROM a x JOIN a y ON x.tag = y.tag AND y.n = x.n + 1 WHERE x.n % 2 = 1 AND x.n <= 300 AND x.entity <> y.entity),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sha256('s anchors:' || tag || ':' || text), text) AS n FROM d) WHERE n <= 600),
u AS (SELECT tag, text, row_number() OVER (PARTITION BY tag ORDER BY sha256('s anchors pool:' || text), text) - 1 AS slot FROM pool WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.tag = pool.tag AND d.text = pool.text)),
us AS (SELECT tag, count(*) AS size FROM u GROUP BY tag),
an AS (SELECT DISTINCT tag, unnest([tag, tag || '. Made by ' || tag]) AS anchor FROM m),
r AS (SELECT few.tag, anchor, text AS positive, CASE WHEN size > 0 THEN ('0x' || substr(sha256('s anchors:' || anchor || ':' || text), 1, 8))::BIGINT % size END AS slot FROM few JOIN an USING (tag) LEFT JOIN us USING (tag)),
tr AS (SELECT r.tag, anchor, positive, u.text AS negative FROM r LEFT JOIN u ON u.tag = r.tag AND u.slot = r.slot),
every AS (SELECT 'self' AS kind, text AS anchor, text AS positive, NULL AS negative FROM (SELECT DISTINCT text FROM t) UNION ALL SELECT 'tag', anchor, positive, NULL FROM tp
  UNION ALL SELECT 'anchor', anchor, positive, NULL FROM tr WHERE negative IS NULL UNION ALL SELECT 'triplet', anchor, positive, negative FROM tr WHERE negative IS NOT NULL
  UNION ALL SELECT 'llm', 'find ' || text, text, NULL FROM (SELECT DISTINCT text FROM t) WHERE text LIKE '1%')
"""


def _assembled(spark: SparkSession, sf_dir: str, co_tag_sample: int | None = None) -> TrainingSet:
    members = order_brands(spark, sf_dir)
    text = F.concat_ws(" ", "o_orderpriority", F.floor(F.col("o_totalprice") / 5000).cast("string"))
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.lit(0).alias("fragment"), F.sha2(text, 256).alias("text_hash"), text.alias("text"))
    tags = members.select("tag").distinct().withColumn("description", F.concat(F.lit("Made by "), "tag"))
    cache = texts.where("text LIKE '1%'").select(F.col("text_hash").alias("hash"), "text", F.array(F.concat(F.lit("find "), "text")).alias("queries"), F.lit("m").alias("llm")).distinct()
    return assemble(texts, members, tags, cache, "s", co_tag_sample=co_tag_sample)


@query(ASSEMBLED.format(first=" WHERE n <= 200") + "SELECT kind, count(*) AS n, sum(('0x' || substr(sha256(anchor || '|' || positive || '|' || coalesce(negative, '')), 1, 8))::BIGINT)::BIGINT AS checksum FROM every GROUP BY kind")
def dataset_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs and triplets, as their number and a sum of digests for each kind."""
    made = _assembled(spark, sf_dir, co_tag_sample=200)
    rows = made.pairs.withColumn("negative", F.lit("")).unionByName(made.triplets.select(F.lit("triplet").alias("kind"), "anchor", "positive", "negative"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", "anchor", "positive", "negative"), 256), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(digest).alias("checksum"))


@query(
    ASSEMBLED.format(first="")
    + """SELECT (SELECT count(*) FROM t) AS fragments, (SELECT count(DISTINCT text) FROM t) AS texts, (SELECT count(DISTINCT tag) FROM m) AS train_tags, (SELECT count(DISTINCT tag) FROM p) AS attributed_tags,
count(*) FILTER (kind <> 'triplet') AS pairs, count(*) FILTER (kind = 'llm') AS llm_pairs, count(*) FILTER (kind = 'triplet') AS triplets FROM every"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).stats
