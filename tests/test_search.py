"""Search over distinct vectors, bucketed snapshots and the name index."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from fragmill.operators.encode import HashingEncoder
from fragmill.operators.names import NameIndex, search_names, wanted_grams
from fragmill.operators.score import Seed, score, score_distinct, seed_of_facet
from fragmill.operators.serve import Engine
from fragmill.sources.snapshot import SnapshotStore

DAY = datetime(2024, 1, 1, tzinfo=UTC)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """600 instances of 40 texts, and the texts' vectors."""
    rng = np.random.default_rng(2)
    vectors = [(f"h{k}", [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(40, 6)))]
    rows = [(f"e{k // 4:03}", 0, k % 4, f"h{int(h)}", f"text {h}", float(1 + h % 5)) for k, h in enumerate(rng.integers(0, 40, 600))]
    return spark.createDataFrame(rows, "entity_id string, facet_ix int, fragment_ix int, text_hash string, text string, idf double").cache(), spark.createDataFrame(vectors, "text_hash string, vector array<double>").cache()


def test_each_distinct_vector_is_compared_once(spark: SparkSession, corpus: tuple) -> None:
    instances, vectors = corpus
    keys, counted = ["entity_id", "facet_ix"], Observation("compared")
    seed = seed_of_facet(instances, F.col("entity_id") == "e007", exclude=(1,), vectors=vectors)
    alive = instances.select(*keys).where("entity_id > 'e020'").distinct()
    bounds = {"ignore": 0.2, "drop": 0.99}
    two = score_distinct(instances, vectors, seed, keys, alive=alive, counted=counted, **bounds).collect()
    one = score(instances.join(vectors, "text_hash").join(alive, keys, "left_semi"), seed, keys, **bounds).collect()
    assert sorted(two) == sorted(one) and len(two) > 50
    assert counted.get["vectors"] == 40 < instances.count()
    assert seed == seed_of_facet(instances.join(vectors, "text_hash"), F.col("entity_id") == "e007", exclude=(1,))


@pytest.fixture(scope="module")
def store(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> SnapshotStore:
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")), buckets=4, row_group=4096)
    rows = spark.range(4000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"), F.struct(F.col("id").alias("n"), F.array(F.lit("x")).alias("l")).alias("nested"))
    terms = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("text_hash"), F.concat(F.lit("draw "), F.col("id").cast("string")).alias("normalized"))
    fragments = spark.range(3000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.sha2((F.col("id") % 500).cast("string"), 256).alias("text_hash"))
    store.publish({"entities": rows, "fragments": fragments, "log": spark.range(3)}, terms, HashingEncoder(8), "v1", DAY)
    return store


def test_the_vector_join_of_a_snapshot_has_no_shuffle(spark: SparkSession, store: SnapshotStore) -> None:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.table("fragments").join(store.table("vectors"), "text_hash")
        assert "Exchange" not in plan_of(joined) and joined.count() == 3000
        seed = Seed([[[1.0] * 8]])
        rows = store.table("fragments").select("*", *(F.lit(x).alias(n) for n, x in (("fragment_ix", 0), ("idf", 1.0), ("text", "t"))))
        assert plan_of(score_distinct(rows, store.table("vectors"), seed, ["entity_id"])).count("Exchange") == 1  # that by facet
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_look_up_reads_one_bucket_and_few_row_groups(spark: SparkSession, store: SnapshotStore) -> None:
    entities = store.table("entities")
    assert entities.count() == 4000 and entities.where("entity_id = 'e17'").first()["nested"]["n"] == 17
    found = entities.where("entity_id = 'e17'")
    assert "EqualTo(entity_id,e17)" in plan_of(found)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scans = [plan]
    while scans and "Scan" not in scans[0].nodeName():
        node = scans.pop(0)
        children = node.children()
        scans += [children.apply(k) for k in range(children.size())]
    read = scans[0].metrics().apply("numOutputRows").value()
    assert 0 < read < 400  # of 4,000 rows, about 1,000 in the bucket: the other files and row groups are skipped
    assert store.table("log").count() == 3  # a table without a key


def test_rows_lie_in_order(spark: SparkSession, store: SnapshotStore) -> None:
    for part in store.table("entities").select(F.spark_partition_id().alias("p"), "entity_id").groupBy("p").agg(F.collect_list("entity_id").alias("ids")).collect():
        assert part["ids"] == sorted(part["ids"])


def test_new_snapshots_reuse_and_old_ones_go(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path), buckets=2)
    terms = spark.createDataFrame([("a", "draw"), ("b", "gain")], "text_hash string, normalized string")
    for k in range(8):
        name = store.publish({"facets": terms}, terms.where(f"text_hash <> 'b' OR {k} % 2 = 0"), HashingEncoder(4), f"v{k}", DAY.replace(day=k + 1))
        assert store.table("vectors").count() == 2 - k % 2 and name in store.snapshots()
    assert len(store.snapshots()) == 5
    before = {t.name for t in spark.catalog.listTables()}
    store.publish({"facets": terms}, terms, HashingEncoder(4), "v9", DAY.replace(day=20))
    assert {t.name for t in spark.catalog.listTables()} < before  # the catalogue forgets a deleted snapshot's tables


def test_a_failure_before_the_pointer_leaves_the_live_snapshot(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path), buckets=2)
    terms = spark.createDataFrame([("a", "draw")], "text_hash string, normalized string")
    store.publish({"facets": terms}, terms, HashingEncoder(4), "v1", DAY)
    write = store.write_json

    def fails(name: str, value: dict) -> None:
        if name == "current.json":
            raise OSError("lost")
        write(name, value)

    monkeypatch.setattr(store, "write_json", fails)
    with pytest.raises(OSError, match="lost"):
        store.publish({"facets": terms.limit(0)}, terms, HashingEncoder(4), "v2", DAY.replace(day=2))
    assert store.current()["version"] == "v1" and store.table("facets").count() == 1
    monkeypatch.undo()
    assert store.publish({"facets": terms.limit(0)}, terms, HashingEncoder(4), "v2", DAY.replace(day=2)) and store.table("facets").count() == 0


def test_the_name_index_equals_a_scan(spark: SparkSession) -> None:
    rng = np.random.default_rng(9)
    names = ["".join(rng.choice(list("abÄé%_ '日"), int(rng.integers(0, 7)))) for _ in range(400)] + [None, "", "a", "Ab", "AB"]
    rows = spark.createDataFrame([(k, n, [None, 0, 5, 7][k % 4]) for k, n in enumerate(names)], "id long, name string, rank int").cache()
    index = NameIndex.of(rows, ["id"])
    index = NameIndex(index.postings.cache(), index.counts.cache(), ["id"])
    for q in ("a", "%", "_", "ab", "äé", "日a", " B ", "ab%", "a'b", "é日_a", "zz", "", "  "):
        found = search_names(index.candidates(rows, q), q, 500, ties=("id",)).collect()
        assert found == search_names(rows, q, 500, ties=("id",)).collect(), q
    assert wanted_grams("abcd") == ["abc", "bcd"] and wanted_grams(" A ") == ["a"] and wanted_grams(" ") == []
    assert index.chosen("ab%_'é") is None or index.candidates(rows, "ab%_'é").count() < 40


def test_an_engine_of_a_snapshot(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    kinds = "entity_id string, facet_ix int, fragment_ix int, text string, normalized string, text_hash string, idf double"
    rows = [("hawk", 0, 0, "Flying", "flying.", "h1", 1.0), ("hawk", 0, 1, "Haste", "haste.", "h2", 2.0), ("bird", 0, 0, "Flying", "flying.", "h1", 1.0), ("ox", 0, 0, "Dig", "dig.", "h3", 2.0)]
    fragments = spark.createDataFrame(rows, kinds)
    entities = spark.createDataFrame([(e, e, e.title(), "normal", 1.0, k, "rare", None, "s", "b", "W", None) for k, e in enumerate(("hawk", "bird", "ox"))], "entity_id string, record_id string, name string, layout string, cmc double, rank int, rarity string, legalities map<string,string>, set_code string, border_color string, identity string, keywords array<string>")
    facets = spark.createDataFrame([(e, 0, e.title(), "Creature", "t", ["creature"], ["W"], None, None, None) for e in ("hawk", "bird", "ox")], "entity_id string, facet_ix int, name string, type_line string, text string, categories array<string>, colors array<string>, mana_cost string, power string, toughness string")
    store, index = SnapshotStore(spark, str(tmp_path), buckets=2), NameIndex.of(facets, ["entity_id", "facet_ix"])
    tables = {"entities": entities, "facets": facets, "fragments": fragments}
    store.publish({**tables, "name_grams": index.postings, "name_counts": index.counts}, fragments.select("text_hash", "normalized").distinct(), HashingEncoder(64), "v1", DAY)
    served = Engine.of_snapshot(store, HashingEncoder(64), {"flying", "haste"})
    assert [(h["entity_id"], h["similarity"]) for h in served.search("flying // haste").collect()][0] == ("hawk", 1.0)
    assert served.similar("bird").first()["entity_id"] == "hawk" and served.entity("ox").first()["name"] == "Ox"
    assert [r["name"] for r in served.names("w").collect()] == ["Hawk"]
    store.publish(tables, fragments.select("text_hash", "normalized").distinct(), HashingEncoder(64), "v2", DAY.replace(day=2))
    assert Engine.of_snapshot(store, HashingEncoder(64)).name_index is None
