"""Queries of the search as a whole over a corpus made of all parts: build, encode, weigh, filter, score, page; names; snapshots."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import filters, records
from ..operators.encode import HashingEncoder
from ..operators.fragments import fragments, terms
from ..operators.index import with_idf
from ..operators.names import NameIndex, search_names
from ..operators.serve import Engine
from ..sources.scratch import new_path, written
from ..sources.snapshot import SnapshotStore
from .catalog import query, table
from .texts import _BUILT, CRC, FACET_TEXT, KEYWORDS, TEMPLATES, parts

ENTITY = "concat('p', p_partkey)"


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, facets and instances (with idf, without vectors): a part is an entity of one facet."""
    rows = parts(spark, sf_dir, entity_id=ENTITY, text=FACET_TEXT)
    null = lambda kind: F.lit(None).cast(kind)
    own = rows.select(
        "entity_id", F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("record_id"), F.col("p_brand").alias("name"), F.lit("normal").alias("layout"), (F.col("p_partkey") % 7).cast("int").alias("rank"),
        F.col("p_brand").alias("rarity"), null("map<string,string>").alias("legalities"), null("string").alias("border_color"), null("string").alias("set_code"), F.lit("").alias("identity"), F.col("p_size").cast("double").alias("cmc"),
        null("array<string>").alias("keywords"),
    )
    faces = rows.select(
        "entity_id", F.lit(0).alias("facet_ix"), F.col("p_brand").alias("name"), F.lit("").alias("type_line"), "text", records.type_categories(F.lit("")).alias("categories"),
        null("array<string>").alias("colors"), *(null("string").alias(c) for c in ("mana_cost", "power", "toughness")),
    )
    built = written(fragments(faces, KEYWORDS, TEMPLATES), "fragments")  # normalized once
    return own, faces, written(with_idf(built, "text_hash"), "instances")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    own, faces, instances = corpus(spark, sf_dir)
    vectors = written(HashingEncoder().encode(terms(instances)), "vectors")
    return Engine(own, faces, instances, HashingEncoder(), KEYWORDS, TEMPLATES, vectors)


#: Fragments, vectors as (text_hash, slot, val), idf, and the scores of all facets against seeds (six, seed_hash, weight).
_INDEX = f"""WITH b AS MATERIALIZED (SELECT 'p' || entity_id AS entity_id, fragment_ix, text, normalized, text_hash FROM ({_BUILT})),
asked AS (SELECT unnest([{{asked}}]) AS normalized),
u AS (SELECT DISTINCT text_hash, normalized FROM b UNION SELECT sha256(normalized), normalized FROM asked),
w AS (SELECT text_hash, unnest(regexp_extract_all(lower(normalized), '[a-z]+')) AS w FROM u),
k AS MATERIALIZED (SELECT w, {CRC.format("w")} % 512 AS slot FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT text_hash, slot, count(*) AS n FROM w JOIN k USING (w) GROUP BY text_hash, slot),
v AS (SELECT text_hash, sqrt(sum(n * n)) AS norm FROM c GROUP BY text_hash),
x AS MATERIALIZED (SELECT text_hash, slot, (n / norm)::FLOAT::DOUBLE AS val FROM c JOIN v USING (text_hash)),
d AS (SELECT text_hash, ln(1 + (SELECT count(*) FROM b) / count(*)) AS idf FROM b GROUP BY text_hash)"""


def _index(asked: str) -> str:
    """The SQL with the normalized texts of a query."""
    return _INDEX.replace("{asked}", asked)


_SCORED = """, m AS (SELECT a.text_hash, s.six, sum(a.val * z.val) AS sim FROM s JOIN x z ON z.text_hash = s.seed_hash JOIN x a ON a.slot = z.slot GROUP BY ALL),
p AS (SELECT b.entity_id, b.fragment_ix, b.text, d.idf, s.six, s.weight, coalesce(m.sim, 0) AS sim
      FROM b JOIN d USING (text_hash) CROSS JOIN s LEFT JOIN m ON m.text_hash = b.text_hash AND m.six = s.six),
f AS (SELECT entity_id, sum(top * weight) / sum(weight) AS fwd FROM (SELECT entity_id, six, weight, max(sim) AS top FROM p GROUP BY ALL) GROUP BY entity_id),
g AS (SELECT entity_id, fragment_ix, text, idf, max(sim) AS best FROM p GROUP BY ALL),
bw AS (SELECT entity_id, sum(best * idf) / sum(idf) AS bwd, max(best) AS top FROM g GROUP BY entity_id),
shown AS (SELECT g.entity_id, nullif(arg_min(g.text, (-idf, fragment_ix)), '') AS matched FROM g JOIN bw ON g.entity_id = bw.entity_id AND g.best >= bw.top - 0.05 GROUP BY g.entity_id),
h AS (SELECT entity_id, {score} AS score, matched, (p_partkey % 7)::INTEGER AS rank, p_size, p_brand FROM f JOIN bw USING (entity_id) JOIN shown USING (entity_id) JOIN part ON 'p' || p_partkey = entity_id)
SELECT entity_id, 0 AS facet_ix, round(score, 6) AS similarity, matched, rank FROM h WHERE {where} ORDER BY round(score, 4) DESC, nullif(rank, 0) NULLS LAST, entity_id LIMIT {limit} OFFSET {offset}"""
_SHOWN = ["entity_id", "facet_ix", "similarity", "matched", "rank"]


@query(
    _index("'vigilance.', 'deals seven damage.'")
    + ", s AS (SELECT row_number() OVER () AS six, sha256(normalized) AS seed_hash, 1.0::DOUBLE AS weight FROM asked)"
    + _SCORED.format(score="fwd", where="p_size BETWEEN 5 AND 40", limit=30, offset=10)
)
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of two fragments through the engine, the second page, under a filter; each distinct vector is compared once."""
    return engine(spark, sf_dir).search("vigilance // deals seven damage // vigilance", filters.Filters(cmc_min=5, cmc_max=40), limit=30, offset=10).select(*_SHOWN)


@query(
    _index("''")
    + ", s AS (SELECT fragment_ix AS six, text_hash AS seed_hash, idf AS weight FROM b JOIN d USING (text_hash) WHERE entity_id = 'p6')"
    + _SCORED.format(score="(fwd + bwd) / 2", where="entity_id <> 'p6' AND p_brand <> 'Brand#11'", limit=25, offset=0)
)
def engine_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets like all fragments of one facet, both ways, among the brands but one."""
    served = engine(spark, sf_dir)
    brands = tuple(r["name"] for r in served.entities.select("name").distinct().collect() if r["name"] != "Brand#11")  # a fixed list of brands
    return served.similar("p6", wanted=filters.Filters(rarities=brands), limit=25).select(*_SHOWN)


NAME_QUERIES = (" E ", "an", "ing", "%", "_", "st", "Ste el", "olis", "zzzz", "")


@query(
    " UNION ALL ".join(
        f"""(SELECT '{q}' AS query, p_partkey, p_name, CASE WHEN lower(p_name) = '{w}' THEN 0 WHEN starts_with(lower(p_name), '{w}') THEN 1 ELSE 2 END AS match_class FROM part
WHERE contains(lower(p_name), '{w}') AND '{w}' <> '' ORDER BY match_class, p_retailprice NULLS LAST, p_name, p_partkey LIMIT 20 OFFSET 1)"""
        for q in NAME_QUERIES
        for w in [q.strip().lower()]
    )
)
def name_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name searches by the inverted index, also of one and two letters and of the signs that a pattern would read otherwise."""
    named = table(spark, sf_dir, "part")
    index = NameIndex.of(named, ["p_partkey"], "p_name")
    postings = written(index.postings.repartitionByRange("gram").sortWithinPartitions("gram"), "name-grams")
    index = NameIndex(postings, written(index.counts, "name-counts"), index.keys)
    out = None
    for q in NAME_QUERIES:
        found = search_names(index.candidates(named, q), q, 20, 1, name="p_name", rank="p_retailprice", ties=("p_partkey",))
        found = found.select(F.lit(q).alias("query"), "p_partkey", "p_name", "match_class")
        out = found if out is None else out.unionByName(found)
    return out


#: About so many rows of the fragments lie in a bucket, so that there are more of them as the corpus grows.
BUCKET_ROWS = 100_000


def _published(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    own, faces, instances = corpus(spark, sf_dir)
    store = SnapshotStore(spark, new_path(spark, "snapshots"), buckets=max(8, -(-instances.count() // BUCKET_ROWS)))
    index = NameIndex.of(faces, ["entity_id", "facet_ix"])
    store.publish({"entities": own, "facets": faces, "fragments": instances, "name_grams": index.postings, "name_counts": index.counts}, terms(instances), HashingEncoder(), "v1", datetime(2024, 1, 1, tzinfo=UTC))
    return store


@query(_index("''") + " SELECT entity_id, fragment_ix, count(slot) AS filled FROM b LEFT JOIN c USING (text_hash) GROUP BY ALL")
def snapshot_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with their vectors from a snapshot, whose tables lie in the same buckets: the places that a vector fills."""
    store = _published(spark, sf_dir)
    filled = store.table("vectors").select("text_hash", F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("filled"))
    # a bucket's distinct texts are hashed, and its fragments stream past them unsorted: one text can have most of them
    return store.table("fragments").join(filled.hint("shuffle_hash"), "text_hash").select("entity_id", "fragment_ix", "filled")


@query("SELECT 'p' || p_partkey AS entity_id, 0 AS facet_ix, p_brand AS name, p_size::DOUBLE AS cmc FROM part WHERE p_partkey IN (6, 77, 101)")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their facets by id from a snapshot's buckets; one that isn't there raises."""
    served = Engine.of_snapshot(_published(spark, sf_dir), HashingEncoder(), KEYWORDS, TEMPLATES)
    found = served.entity("p6").unionByName(served.entity("p77")).unionByName(served.entity("p101"))
    return found.select("entity_id", F.explode("facets").alias("f"), "cmc").select("entity_id", "f.facet_ix", "f.name", "cmc")


@query(
    """(SELECT 'p' || p_partkey AS entity_id, p_brand AS name, (p_partkey % 7)::INTEGER AS rank FROM part WHERE contains(lower(p_brand), 'd#2') ORDER BY p_partkey % 7, p_brand, 'p' || p_partkey LIMIT 40)"""
)
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name search by the index that was published with the snapshot."""
    served = Engine.of_snapshot(_published(spark, sf_dir), HashingEncoder(), KEYWORDS, TEMPLATES)
    return served.names("D#2", limit=40).select("entity_id", "name", "rank")
