"""The request surface over a small built corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import Column, SparkSession, functions as F

from fragmill.functions.normalize import normalize
from fragmill.operators import filters, records, serve
from fragmill.operators.encode import HashingEncoder
from fragmill.operators.fragments import fragments, terms
from fragmill.operators.index import with_idf, with_vectors
from fragmill.operators.serve import Engine, query_fragments
from fragmill.sources.tables import recover_queries

KEYWORDS = {"flying", "haste"}


@pytest.fixture(scope="module")
def engine(spark: SparkSession) -> Engine:
    names = "id string, oracle_id string, name string, layout string, type_line string, oracle_text string, edhrec_rank int, rarity string, colors array<string>, color_identity array<string>, keywords array<string>, cmc double, legalities map<string,string>, `set` string, border_color string, mana_cost string, power string, toughness string, loyalty string, defense string"
    rows = [
        ("1", "mage", "Mage", "normal", "Creature — Elf", "{T}: Add {G}.", 3, "common", ["G"], ["G"], None, 1.0, {"modern": "legal"}),
        ("2", "hill", "Hill", "normal", "Land", "{T}: Add {G}.", 1, "common", [], ["G"], [], None, {}),
        ("3", "hawk", "Hawk", "normal", "Creature", "Flying\nHaste\nLandfall — Draw a card.", None, "rare", ["W"], ["W"], ["Flying"], 2.0, {}),
        ("4", "bird", "Bird Hawk", "normal", "Creature", "Flying", 2, "rare", ["W"], ["W"], ["flying"], 2.0, {}),
    ]
    best = spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], names).withColumn("card_faces", F.lit(None).cast("array<struct<name:string,mana_cost:string,type_line:string,oracle_text:string,power:string,toughness:string,loyalty:string,defense:string,colors:array<string>>>"))
    facets = records.facets(best).cache()
    parts = fragments(facets, KEYWORDS, {})
    encoder = HashingEncoder()
    instances = with_vectors(with_idf(parts, "text_hash"), encoder.encode(terms(parts))).cache()
    return Engine(records.entities(best).cache(), facets, instances, encoder, KEYWORDS)


def test_query_variants(spark: SparkSession) -> None:
    parts = query_fragments(spark, "{T}: Add {G}. // flying, haste // flying", KEYWORDS, {})
    assert [p[0] for p in parts] == ["{T}: Add {G}.", "flying", "haste"] and len(parts[0][1]) > 1 and len(parts[1][1]) == 1
    assert query_fragments(spark, None, KEYWORDS, {}) == []


def test_search(engine: Engine) -> None:
    hits = engine.search("{T}: Add {G}.", limit=2).collect()
    assert [(h["entity_id"], h["similarity"]) for h in hits] == [("hill", 1.0), ("mage", 1.0)]
    assert [h["entity_id"] for h in engine.search("{T}: Add {G}.", filters.Filters(categories=("creature",)), limit=1).collect()] == ["mage"]
    with pytest.raises(ValueError):
        engine.search("a // b // c // d // e // f // g")


def test_similar(engine: Engine) -> None:
    hits = engine.similar("bird").collect()
    assert hits[0]["entity_id"] == "hawk" and "bird" not in {h["entity_id"] for h in hits} and hits[0]["matched"] == "Flying"
    assert engine.similar("nobody").count() == 0
    assert [h["entity_id"] for h in engine.similar("bird", limit=1, offset=1).collect()] == [engine.similar("bird").collect()[1]["entity_id"]]


def test_names_entities_and_samples(engine: Engine) -> None:
    assert [r["name"] for r in engine.names("hawk").collect()] == ["Hawk", "Bird Hawk"]
    assert engine.entity("hawk").first()["facets"][0]["name"] == "Hawk"
    with pytest.raises(KeyError):
        engine.entity("nobody")
    assert engine.sample_texts(2, "s").count() == 2
    assert {r["term"].lower() for r in engine.sample_terms(9, "s").collect()} == {"flying", "landfall"}


def test_codes() -> None:
    assert filters.encode_codes(["rare", "odd", "rare"], {"r": "rare"}) == "r"


def test_recover(spark: SparkSession) -> None:
    pairs = spark.createDataFrame([("draw a card", "Draw.", 0), ("mana dork", "Tap.", 1), ("old tag", "Tap.", 2)], "anchor string, text string, pos int")
    triplets, anchors = spark.createDataFrame([("old tag",)], "anchor string"), spark.createDataFrame([("mana dork",)], "anchor string")
    assert [(r["text"], r["queries"]) for r in recover_queries(pairs, triplets, anchors, "m").collect()] == [("Draw.", ["draw a card"])]


def test_a_query_fragment_is_normalized_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Under a mark, unless it has the mark's letters; the variants are those of each kind of object."""
    texts = ["{T}: Add {G}.", "{q}, {T}, {T}: Draw 2 cards.", "flying", "qjqjq {T}: Add {G}.", "qj'qjq {T}", "{QJQJQ/P} {T}", "(gone)", "{T} 2/2 this creature", "", "+1: this land {T}{T}{T}"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds = F.array(*(normalize(F.col("text"), F.lit(""), F.lit(t)) for t in serve.QUERY_TYPE_LINES))
    got = rows.select("text", serve.variants(F.col("text")).alias("got"), kinds.alias("wanted")).collect()
    assert all(r["got"] == r["wanted"] for r in got) and len(got) == len(texts)

    def under_a_mark(text: Column, name: Column, type_line: Column, **mark: Column) -> Column:
        return normalize(text, name, type_line, **mark) if mark else F.raise_error(F.lit("normalized under each kind")).cast("string")

    monkeypatch.setattr(serve, "normalize", under_a_mark)
    once = rows.where("text in ('{T}: Add {G}.', 'flying')").select(serve.query_parts(F.col("text"), KEYWORDS, {}).alias("parts")).collect()
    assert sorted(len(r["parts"][0]["variants"]) for r in once) == [1, 7]
