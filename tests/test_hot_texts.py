"""Texts that a large part of all facets share are no load for one task."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession, functions as F

from fragmill.operators.encode import HashingEncoder
from fragmill.operators.fragments import fragments, terms
from fragmill.operators.index import with_idf
from fragmill.operators.score import Seed, score_distinct
from fragmill.sources.snapshot import SnapshotStore


def test_fragments_are_told_apart_in_their_row(spark: SparkSession) -> None:
    rows = [("a", 0, "Draw.\nflying\nGain.\nDraw\ndraw."), ("b", 0, None), ("b", 1, "(gone)\n(too)\nWin."), ("c", 0, "(gone)")]
    facets = spark.createDataFrame(rows, "entity_id string, facet_ix int, text string").select("*", F.lit("X").alias("name"), F.lit("").alias("type_line"))
    built = fragments(facets, {"flying"}, {})
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
    found = sorted((r["entity_id"], r["facet_ix"], r["fragment_ix"], r["text"], r["normalized"], r["is_keyword"]) for r in built.collect())
    assert found == [
        ("a", 0, 0, "Draw.", "Draw.", False), ("a", 0, 1, "flying", "flying.", True), ("a", 0, 2, "Gain.", "Gain.", False), ("a", 0, 3, "draw.", "draw.", False),
        ("b", 0, 0, "", "emptyoracle", False), ("b", 1, 0, "Win.", "Win.", False), ("c", 0, 0, "", "emptyoracle", False),
    ]


def test_the_rows_of_one_term_are_dealt_to_all_tasks(spark: SparkSession) -> None:
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3900, "hot").otherwise(F.col("id").cast("string")).alias("term"), F.create_map(F.lit("k"), "id").alias("m"))
    rows = rows.unionByName(rows.where("id = 0").withColumn("term", F.lit(None).cast("string")))  # no term, no frequency
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = with_idf(rows).withColumn("p", F.spark_partition_id())
        dealt = {r["p"]: r["n"] for r in made.groupBy("p").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(dealt.values()) == 4000 and max(dealt.values()) < 2000
    assert {(r["term"] == "hot", r["df"]) for r in with_idf(rows).collect()} == {(True, 3900), (False, 1)}


def test_instances_of_a_text_stream_past_its_vector(spark: SparkSession) -> None:
    rows = spark.range(300).select(F.col("id").alias("entity_id"), F.lit(0).alias("fragment_ix"), F.lit(1.0).alias("idf"), F.lit("t").alias("text"), F.when(F.col("id") < 290, "hot").otherwise("rare").alias("text_hash"))
    vectors = spark.createDataFrame([("hot", [1.0, 0.0]), ("rare", [0.6, 0.8])], "text_hash string, vector array<double>")
    scored = score_distinct(rows, vectors, Seed([[[1.0, 0.0]]]), ["entity_id"])
    assert "ShuffledHashJoin" in (plan := scored._jdf.queryExecution().sparkPlan().toString()) and "SortMergeJoin" not in plan
    assert {(r["entity_id"] < 290, r["score"]) for r in scored.collect()} == {(True, 1.0), (False, 0.6)} and scored.count() == 300


def test_one_row_for_each_hash(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("h", "x"), ("h", "x"), ("h", "y"), ("g", "z")], "text_hash string, normalized string")
    assert sorted(r["text_hash"] for r in terms(rows).collect()) == ["g", "h"]


def test_a_text_of_most_fragments_is_cut_in_its_bucket(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path), buckets=4)
    known = spark.createDataFrame([("hot", "draw"), ("x", "gain"), ("y", "win")], "text_hash string, normalized string")
    held = F.when(F.col("id") < 3900, "hot").when(F.col("id") < 3950, "x").otherwise("y")
    rows = spark.range(4000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), held.alias("text_hash"))
    store.publish({"fragments": rows}, known, HashingEncoder(4), "v1", datetime(2024, 1, 1, tzinfo=UTC))
    table = store.table("fragments")
    files = [r["n"] for r in table.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(files) == 4000 and max(files) < 2000
    joined = table.join(store.table("vectors").hint("shuffle_hash"), "text_hash")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 4000
    assert table.where("text_hash = 'hot'").count() == 3900 and table.where("text_hash = 'y'").count() == 50
