"""Normalization, segmentation and fragments against exact strings."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.functions.normalize import normalize
from fragmill.functions.segment import is_keyword, split_lines, split_query
from fragmill.functions.tokens import content_tokens, query_lines, tag_anchors
from fragmill.operators.fragments import fragments

KEYWORDS = {"flying", "vigilance", "haste", "first strike", "ward", "protection", "cycling", "bushido", "overload"}

CASES = [
    ("{T}: Add {G}.", "Moss Elder", "Creature — Elf", "tap this creature: Add one green mana."),
    ("{T}: Add {G}.", "Grove", "Basic Land — Forest", "tap this land: Add one green mana."),
    ("{T}: Add {C}.", "Thing", "", "tap this card: Add one colorless mana."),
    ("{2}{G}{G}, {T}: Draw a card.", "Thing", "Artifact", "pay two generic mana and two green mana and tap this artifact: Draw a card."),
    ("{Q}: Look at the top of it", "Crane", "Creature — Heron", "untap this creature: Look at the top of it."),
    ("Thing deals 3 damage to Thing.", "Thing", "Instant", "this spell deals three damage to this spell."),
    ("Ann, Lost Heir fights. Ann wins.", "Ann, Lost Heir", "Legendary Creature — Human", "this creature fights. this creature wins."),
    ("Put a +1/+1 counter on it.", "", "", "Put a plus one strength and plus one toughness counter on it."),
    ("It becomes a 0/3 token.", "", "", "It becomes a three toughness token."),
    ("It becomes X/Y.", "", "", "It becomes x power and y toughness."),
    ("+2: Draw 30 cards.", "", "", "add two loyalty counters: Draw 30 cards."),
    ("-1: Draw.", "", "", "remove one loyalty counter: Draw."),
    ("Fly (It soars.) high", "", "", "Fly high."),
    ("{E}{E}", "", "", "two energy counters."),
    ("{T}{T}", "", "Artifact", "tap this artifact twice."),
    ("{X}{W/U}{P}", "", "", "x mana and white or blue mana."),
    ("don't — stop!!", "", "", "dont stop"),
    (None, "", "", "emptyoracle"),
    ("(all of it)", "", "", "emptyoracle"),
]


def test_normalize(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, text string, name string, type string")
    out = {r["k"]: r["n"] for r in rows.select("k", normalize(F.col("text"), F.col("name"), F.col("type")).alias("n")).collect()}
    assert [out[k] for k in range(len(CASES))] == [c[3] for c in CASES]


def test_names_with_special_characters(spark: SparkSession) -> None:
    names = ["A [B] $1", r"X\E.Y", "a+b*", "N"]
    rows = spark.createDataFrame([(n, f"{n} runs. N N N") for n in names], "name string, text string")
    out = [r[0] for r in rows.select(normalize(F.col("text"), F.col("name"), F.lit("Land"))).collect()]
    assert all(o.startswith("this land runs.") for o in out)
    assert out[3] == "this land runs. this land N this land."  # the delimiter is consumed


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Flying, vigilance, haste", ["Flying", "vigilance", "haste"]),
        ("First strike; bushido 2.", ["First strike", "bushido 2"]),
        ("Protection from red; ward {2}", ["Protection from red", "ward {2}"]),
        ("Search for a hill, reveal it, then shuffle.", ["Search for a hill, reveal it, then shuffle."]),
        ("Choose one —\n• Draw.\n• Gain 3.", ["Choose one —\n• Draw.\n• Gain 3."]),
        ("  \nFlying (a, b; c)\n\n", ["Flying (a, b; c)"]),
        ("", []),
        (None, []),
    ],
)
def test_split_lines(spark: SparkSession, text: str | None, expected: list[str]) -> None:
    assert spark.range(1).select(split_lines(F.lit(text).cast("string"), KEYWORDS)).first()[0] == expected


def test_query_and_keywords(spark: SparkSession) -> None:
    row = spark.range(1).select(split_query(F.lit("draw //flying, haste// "), KEYWORDS), is_keyword(F.lit("Ward {2}{U}"), KEYWORDS), is_keyword(F.lit("draw"), KEYWORDS)).first()
    assert (row[0], row[1], row[2]) == (["draw", "flying", "haste"], True, False)


def test_fragments(spark: SparkSession) -> None:
    facets = spark.createDataFrame(
        [
            ("a", 0, "Wave", "Instant", "Return target hill. Target it.\nOverload {6}{U} (Change it.)"),
            ("b", 0, "Bird", "Creature — Bird", "Flying, haste, Flying\n(nothing)"),
            ("c", 0, "Blank", "Land", None),
            ("d", 1, "Cycler", "Land", "Cycling {2}"),
        ],
        "entity_id string, facet_ix int, name string, type_line string, text string",
    )
    rows = fragments(facets, KEYWORDS, {"Cycling {cost}": "{cost}, Discard this card: Draw a card."}).orderBy("entity_id", "fragment_ix").collect()
    found = {}
    for r in rows:
        found.setdefault(r["entity_id"], []).append((r["fragment_ix"], r["text"], r["normalized"], r["is_keyword"]))
    assert [x[0] for x in found["a"]] == [0, 1, 2]
    assert found["a"][1] == (1, "Overloaded — Return each hill. Each it.", "Return each hill. Each it.", False)
    assert [(x[1], x[3]) for x in found["b"]] == [("Flying", True), ("haste", True)]
    assert found["c"] == [(0, "", "emptyoracle", False)]
    assert found["d"][0][1] == "Cycling {2}" and found["d"][0][2].startswith("Cycling two generic mana.") and found["d"][0][3]


def test_tokens_anchors_and_query_lines(spark: SparkSession) -> None:
    row = spark.range(1).select(
        content_tokens(F.lit("Add the mana, add it a B")), content_tokens(F.lit("End of the")), tag_anchors(F.lit("mana-dork"), F.lit("Taps.")), tag_anchors(F.lit("x_y"), F.lit(None).cast("string")),
        query_lines(F.lit("<think>no no</think>1. Draw a card.\n- draw a card\n* one\n" + "long " * 9 + "\n2) tap for mana;")),
    ).first()
    assert row[0] == ["add", "mana"]
    assert row[1] == ["end"]
    assert row[2] == ["mana dork", "mana dork. Taps."] and row[3] == ["x y"]
    assert row[4] == ["draw a card", "tap for mana"]
