"""Records, scoring relations, filters, training data, evaluation, snapshots and the stream."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import DataFrame, SparkSession, functions as F

from fragmill.functions.exprs import bit_set, bucket_of
from fragmill.operators import evaluate, filters, names, records, score, sequences, training
from fragmill.operators.encode import ArrowEncoder, HashingEncoder
from fragmill.operators.fragments import fragments, terms
from fragmill.operators.index import new_terms, with_idf, with_vectors
from fragmill.sources.snapshot import Follower, SnapshotStore
from fragmill.sources.tables import query_pairs, read_query_cache, read_records, read_tags, to_generate, write_query_cache
from fragmill.streaming.refresh import read_vectors, stream_new_vectors

KEYWORDS = {"flying", "haste"}
FACETS = [
    ("mage", 0, "Mage", "Creature — Elf", "{T}: Add {G}.\nWhen Mage dies, draw a card."),
    ("hill", 0, "Hill", "Land", "{T}: Add {G}."),
    ("bird", 0, "Bird", "Creature — Bird", "Flying"),
    ("hawk", 0, "Hawk", "Creature — Bird", "Flying\nHaste\nWhen Hawk dies, draw a card."),
    ("rock", 0, "Rock", "Artifact", None),
    ("twin", 0, "Twin", "Creature", "Flying\nHaste"),
    ("twin", 1, "Twin Back", "Creature", "Haste"),
]
KEYS = ["entity_id", "facet_ix"]


@pytest.fixture(scope="module")
def corpus(spark: SparkSession) -> DataFrame:
    facets = spark.createDataFrame(FACETS, "entity_id string, facet_ix int, name string, type_line string, text string")
    rows = fragments(facets, KEYWORDS, {})
    vectors = HashingEncoder().encode(terms(rows))
    return with_vectors(with_idf(rows, "text_hash"), vectors).cache()


def scores(corpus: DataFrame, seed: score.Seed, **options: float) -> dict:
    return {(r["entity_id"], r["facet_ix"]): r["score"] for r in score.score(corpus, seed, KEYS, **options).collect()}


def seed(corpus: DataFrame, entity: str, **options: list[int]) -> score.Seed:
    return score.seed_of_facet(corpus, (F.col("entity_id") == entity) & (F.col("facet_ix") == 0), **options)


def test_scores_by_relation(corpus: DataFrame) -> None:
    whole = scores(corpus, seed(corpus, "hawk"))
    assert whole["hawk", 0] == pytest.approx(1.0)
    assert whole["twin", 0] < 0.99 and whole["twin", 0] > whole["rock", 0]
    part = scores(corpus, seed(corpus, "hawk", include=[0, 1]))
    assert part["twin", 0] == pytest.approx(1.0)
    assert scores(corpus, seed(corpus, "hawk", include=[0, 1, 2])) == whole
    assert seed(corpus, "hawk", include=[7]) is None and seed(corpus, "nobody") is None
    rejected = scores(corpus, seed(corpus, "hawk", include=[0, 1], exclude=[0]))
    assert not {("bird", 0), ("twin", 0), ("hawk", 0)} & set(rejected)
    assert ("twin", 1) in rejected


def test_display_and_order(corpus: DataFrame, spark: SparkSession) -> None:
    hits = score.score(corpus, seed(corpus, "twin"), KEYS).join(spark.createDataFrame([("hawk", 5), ("bird", 0)], "entity_id string, rank int"), "entity_id", "left")
    top = score.top_hits(hits, KEYS, 3).collect()
    assert (top[0]["entity_id"], top[0]["facet_ix"]) == ("twin", 0)
    shown = {(r["entity_id"], r["facet_ix"]): r["display"] for r in hits.collect()}
    assert shown["rock", 0] is None and shown["twin", 1] == "Haste"


def test_idf_falls_with_frequency(corpus: DataFrame) -> None:
    rows = corpus.select("df", "idf").distinct().orderBy("df").collect()
    assert [r["idf"] for r in rows] == sorted((r["idf"] for r in rows), reverse=True)


def test_filters(spark: SparkSession) -> None:
    rows = spark.createDataFrame(
        [(1, ["W", "U"], 2.0, {"modern": "restricted"}, "rare"), (2, [], None, {}, None), (3, None, 5.0, {"modern": "banned"}, "common")],
        "k int, colors array<string>, cmc double, legalities map<string,string>, rarity string",
    ).withColumn("identity_mask", bit_set(F.col("colors"), filters.COLORS))

    def kept(f: filters.Filters) -> list[int]:
        return [r["k"] for r in rows.where(f.predicate()).orderBy("k").collect()]

    assert kept(filters.Filters(colors="WU", color_mode="at_least")) == [1]
    assert kept(filters.Filters(colors="WUB", color_mode="at_most")) == [1, 2]
    assert kept(filters.Filters(colors="C", color_mode="exact")) == [1, 2, 3]
    assert kept(filters.Filters(cmc_min=1)) == [1, 3] and kept(filters.Filters(formats=("modern",))) == [1]
    assert kept(filters.Filters(rarities=("",))) == [2]
    assert filters.decode_codes("ab", {"a": "x", "b": "y"}, "type") == ["x", "y"] and filters.fragment_numbers("3,1,1") == [1, 3]
    for bad in (lambda: filters.decode_codes("aa", {"a": "x"}, "type"), lambda: filters.decode_codes("z", {}, "type"), lambda: filters.fragment_numbers("-1"), lambda: filters.check_request(" ", None), lambda: filters.check_request("q", None, limit=0)):
        with pytest.raises(ValueError):
            bad()


def test_names(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("Elf", 9), ("Elf King", 1), ("Self", None), ("Half%", 2)], "name string, rank int")
    assert [r["name"] for r in names.search_names(rows, "elf", 9).collect()] == ["Elf", "Elf King", "Self"]
    assert [r["name"] for r in names.search_names(rows, "f%", 9).collect()] == ["Half%"]
    assert names.search_names(rows, " ", 9).count() == 0


def record(**values: object) -> dict:
    return {"id": "r", "oracle_id": "o", "name": "N", "layout": "normal", "games": ["paper"], "type_line": "Land", **values}


def test_records(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rows = [
        record(id="1", collector_number="2"), record(id="2", collector_number="10"), record(id="3", collector_number="1a"),
        record(id="4", oracle_id="p", games=["mtgo"], released_at="1999-01-01", legalities={"modern": "legal"}), record(id="5", oracle_id="p", released_at="2005-01-01"), record(id="6", oracle_id="p", released_at="2004-01-01"),
        record(id="7", oracle_id="q", card_faces=[{"name": "F", "type_line": "Creature — Elf", "oracle_text": "Flying"}, {"name": "B", "type_line": "Artifact Land"}], color_identity=["G", "W"]),
        record(id="x1", oracle_id="s", layout="token"), record(id="x2", oracle_id="s", games=["arena"]), record(id="x3", oracle_id="s", name="A-N"), record(id="x4", oracle_id="s", arena_id=5), record(id="x5", oracle_id="s", type_line=" Card "), record(id="x6", oracle_id=None),
    ]
    (tmp_path / "bulk.json").write_text("\n".join(json.dumps(r) + "\n" for r in rows))
    best = records.best_records(records.eligible(read_records(spark, str(tmp_path / "bulk.json")))).cache()
    assert {r["oracle_id"]: r["id"] for r in best.collect()} == {"o": "3", "p": "6", "q": "7"}
    entity = records.entities(best).where("entity_id = 'q'").first()
    assert entity["identity"] == "WG"
    faces = records.facets(best).where("entity_id = 'q'").orderBy("facet_ix").collect()
    assert [(f["name"], f["categories"]) for f in faces] == [("F", ["creature"]), ("B", ["artifact", "land"])]


def test_attribution_and_negatives(spark: SparkSession) -> None:
    background = [(f"z{k}", 0, ["draw", "card"] if k % 2 else ["gain", "life"]) for k in range(80)]
    pairs = [(f"m{k}", j, ["tap", "add", "mana"] if j == 0 else ["draw", "card"]) for k in range(30) for j in (0, 1)]
    table = spark.createDataFrame(background + pairs, "entity string, fragment int, tokens array<string>")
    members = spark.createDataFrame([("dork", f"m{k}", k) for k in range(30)] + [("one", "z1", 0), ("one", "m1", 1)], "tag string, entity string, pos int")
    picks = training.attribute(table, members).collect()
    assert {(r["entity"], r["fragment"]) for r in picks if r["tag"] == "dork"} == {(f"m{k}", 0) for k in range(30)}
    assert {(r["entity"], r["fragment"]) for r in picks if r["tag"] == "one"} == {("z1", 0)}
    assert training.attribute(table, members, p=training.Attribution(min_margin=99)).where("tag = 'dork'").count() == 0
    tags = spark.createDataFrame([("a", f"i{k}", k) for k in range(5)] + [("b", f"i{k}", k) for k in range(2, 9)] + [("c", f"i{k}", k) for k in range(0, 100, 50)], "tag string, entity string, pos int")
    pool = [r["entity"] for r in training.hard_negatives(tags).where("tag = 'a'").orderBy("pool_pos").collect()]
    assert pool == ["i5", "i6", "i7", "i8"]


def test_a_small_pool_is_the_start_of_the_whole_pool(spark: SparkSession) -> None:
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", f"e{e}", int(p)) for t in range(8) for p, e in enumerate(rng.permutation(60)[: 20 + t])]
    rows += [("t1", e, p + 100) for _, e, p in rows[:15]] + rows[:30]  # members listed twice
    members = spark.createDataFrame(rows, "tag string, entity string, pos int")
    whole = {(r["tag"], r["pool_pos"]): r["entity"] for r in training.hard_negatives(members).collect()}
    few = {(r["tag"], r["pool_pos"]): r["entity"] for r in training.hard_negatives(members, cap=7).collect()}
    assert few == {k: v for k, v in whole.items() if k[1] <= 7} and len(few) == 56 and len(whole) > 100


def test_pairs_and_triplets(spark: SparkSession) -> None:
    picks = spark.createDataFrame([("t", f"e{k}", f"text {k % 7}", k) for k in range(20)], "tag string, entity string, text string, n int")
    pairs = training.tag_pairs(picks, "n", "salt").collect()
    assert 0 < len(pairs) <= 3 and all(r["anchor"] != r["positive"] for r in pairs)
    pools = spark.createDataFrame([("t", "text 1"), ("t", "other"), ("t", "more")], "tag string, text string")
    anchors = spark.createDataFrame([("t", "name"), ("t", "name. what")], "tag string, anchor string")
    rows = training.triplets(picks, pools, anchors, "n", "salt").collect()
    assert len(rows) == 14 and {r["negative"] for r in rows} <= {"other", "more"}
    none = training.triplets(picks, pools.where("text = 'text 1'"), anchors, "n", "salt").collect()
    assert len(none) == 14 and {r["negative"] for r in none} == {None}
    assert training.self_pairs(picks).count() == 7


def test_metrics(spark: SparkSession) -> None:
    ranked = spark.createDataFrame([(1, f"e{k}", k) for k in range(1, 101)], "query_id int, entity_id string, rank int")
    gold = spark.createDataFrame([(1, f"e{k}") for k in range(2, 101)] + [(1, f"g{k}") for k in range(301)] + [(2, "none")], "query_id int, entity_id string")
    rows = {r["query_id"]: r for r in evaluate.metrics(ranked, gold).collect()}
    assert (rows[1]["mrr"], rows[1]["p_at_10"], rows[1]["recall_at_100"]) == (0.5, 0.9, 0.99)
    assert (rows[2]["mrr"], rows[2]["p_at_10"], rows[2]["recall_at_100"]) == (0.0, 0.0, 0.0)
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id int, entity_id string, rank int")
    assert [(r["entity_id"], r["rank"]) for r in evaluate.entity_ranking(hits).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_holdout_is_nested(spark: SparkSession) -> None:
    rows = spark.range(500).select(bucket_of("s", F.concat(F.lit("n"), F.col("id").cast("string"))).alias("b"))
    assert rows.where("b < 10").count() < rows.where("b < 15").count() and rows.where("b < 0 or b > 99").count() == 0


def test_sequences(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")], "g int, k int, v string")
    assert [r["island"] for r in sequences.islands(rows, ["g"], ["k"], F.col("v")).orderBy("k").collect()] == [1, 1, 2, 2, 3]
    joined = sequences.attach_to_previous(rows, ["g"], "k", F.col("v") == "b", "v").orderBy("block").collect()
    assert [r["v"] for r in joined] == ["a", "a\nb\nb", "a"]
    assert sequences.adjacent_pairs(rows.withColumn("x", F.concat("v", "k")), ["g"], F.col("k"), "x", 9).count() == 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["rare", "common", None]), min_size=1, max_size=6), st.sampled_from(["W", "U", ""]))
def test_a_filter_never_adds_rows(spark: SparkSession, rarities: list, colors: str) -> None:
    rows = spark.createDataFrame([(k, r, k % 4) for k, r in enumerate(rarities)], "k int, rarity string, identity_mask int").withColumn("cmc", F.lit(1.0))
    wide, narrow = filters.Filters(colors=colors), filters.Filters(colors=colors, rarities=("rare",))
    assert rows.where(narrow.predicate()).count() <= rows.where(wide.predicate()).count()


def test_encoders(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("h1", "draw a card"), ("h2", ""), ("h3", "draw a card draw")], "text_hash string, normalized string")
    out = {r["text_hash"]: r["vector"] for r in HashingEncoder(32).encode(rows).collect()}
    assert sum(x * x for x in out["h1"]) == pytest.approx(1, abs=1e-6) and set(out["h2"]) == {0.0} and len(out) == 3
    arrow = ArrowEncoder("len", lambda: lambda texts: [[float(len(t))] for t in texts], batch=2).encode(rows)
    assert {r["text_hash"]: r["vector"] for r in arrow.collect()} == {"h1": [11.0], "h2": [0.0], "h3": [16.0]}


def test_snapshots(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path))
    assert store.current() is None and store.snapshots() == []
    with pytest.raises(FileNotFoundError):
        store.table("terms")
    old = spark.createDataFrame([("a", "draw"), ("b", "gain")], "text_hash string, normalized string")
    follower = Follower(store, ["vectors"])
    assert not follower.poll()
    assert store.publish({"terms": old}, old, HashingEncoder(8), "v1", datetime(2024, 1, 1, tzinfo=UTC)) == "20240101T000000Z"
    assert store.publish({"terms": old}, old, HashingEncoder(8), "v1") is None
    assert follower.poll() and not follower.poll() and follower.tables["vectors"].count() == 2
    new = spark.createDataFrame([("b", "gain"), ("c", "tap")], "text_hash string, normalized string")
    assert [r["text_hash"] for r in new_terms(new, store.table("vectors")).collect()] == ["c"]
    for day in range(2, 9):
        store.publish({"terms": new}, new, HashingEncoder(8), f"v{day}", datetime(2024, 1, day, tzinfo=UTC))
    assert {r["text_hash"] for r in store.table("vectors").collect()} == {"b", "c"}
    assert len(store.snapshots()) == 5 and store.current()["snapshot"] == "20240108T000000Z"
    store.promote("m2")
    assert store.promoted() == "m2"


def test_stream(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    source, vectors, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", "draw"), ("a", "draw"), ("b", "gain")], "text_hash string, normalized string").write.parquet(source)
    assert stream_new_vectors(spark, source, vectors, state, HashingEncoder(8)) == 2
    spark.createDataFrame([("b", "gain"), ("c", "tap")], "text_hash string, normalized string").write.mode("append").parquet(source)
    assert stream_new_vectors(spark, source, vectors, state, HashingEncoder(8)) == 1
    assert read_vectors(spark, vectors, HashingEncoder(8)).count() == 3


def test_tags_and_cache(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "tags.json").write_text("\n".join(json.dumps(r) for r in ({"label": "t", "description": "old", "taggings": []}, {"label": "t", "description": "new", "taggings": [{"oracle_id": "a"}, {"oracle_id": "b"}]})))
    tags, members = read_tags(spark, str(tmp_path / "tags.json"))
    assert tags.first()["description"] == "new" and members.orderBy("pos").first()["entity"] == "a"
    cache = spark.createDataFrame([("h1", "x", ["q one", "q two"], "m")], "hash string, text string, queries array<string>, llm string")
    write_query_cache(cache, str(tmp_path / "cache"))
    again = read_query_cache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([("h1", "x"), ("h2", "y")], "text_hash string, text string")
    assert query_pairs(texts, again).count() == 2 and to_generate(texts, again, 5).first()["text_hash"] == "h2"


def test_seed_of_a_facet_with_too_many_fragments_is_refused(spark: SparkSession) -> None:
    many = spark.range(score.MAX_SEED + 1).select(F.col("id").cast("int").alias("fragment_ix"), F.lit(1.0).alias("idf"), F.array(F.lit(1.0)).alias("vector"))
    assert len(score.seed_of_facet(many.where(F.col("fragment_ix") < score.MAX_SEED), F.lit(True)).groups) == score.MAX_SEED
    with pytest.raises(ValueError, match="at most"):
        score.seed_of_facet(many, F.lit(True), include=[0])
