"""Hard negatives look at the first members only, and at more where those don't fill a pool."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fragmill.operators import training
from fragmill.operators.dataset import assemble


def test_pools_are_whole_after_rounds(spark: SparkSession) -> None:
    """Tag a has nearly all early members of b, so that several rounds are needed for its pool."""
    rows = [("b", e, e) for e in range(60)] + [("a", e, e) for e in range(50) if e != 3] + [("c", e, e) for e in range(0, 60, 5)]
    members = spark.createDataFrame(rows, "tag string, entity int, pos int")
    near, held = training.co_tags(members).collect(), {(t, e) for t, e, _ in rows}
    made = training.hard_negatives(members, cap=4)
    wanted = []
    for tag in "abc":
        at: dict = {}
        for r in near:
            for other, e, pos in rows:
                if r["tag"] == tag and r["other"] == other and (tag, e) not in held:
                    at[e] = min(at.get(e, (99, 99)), (r["place"], pos))
        wanted += [(tag, e, k + 1) for k, (e, _) in enumerate(sorted(at.items(), key=lambda x: (x[1], x[0]))[:4])]
    assert sorted(map(tuple, made.collect())) == sorted(wanted) and any(t == "a" for t, *_ in wanted)


def test_few_candidates_are_shuffled(spark: SparkSession) -> None:
    """No member of an associated tag behind the first is made a candidate: 4 of 2,000 and more than once as many are looked at."""
    rows = [("b", e, e) for e in range(2000)] + [("a", e, e) for e in range(0, 2000, 2)]
    members = spark.createDataFrame(rows, "tag string, entity int, pos int")
    seen: dict = {}
    real = training.written
    training.written = lambda df, name: seen.setdefault(name, real(df, name)) if name == "candidates" else real(df, name)
    try:
        assert training.hard_negatives(members, cap=4).count() == 4
    finally:
        training.written = real
    assert seen["candidates"].count() <= 16


def test_all_members_of_a_tag_are_counted(spark: SparkSession) -> None:
    """Tag late shares members of a only behind its first 200; a row listed twice counts twice for its own tag."""
    rows = [("a", e, e) for e in range(300)] + [("a", 255, 300)] + [("late", e, e) for e in range(250, 261)] + [("late", 900, 900)] + [("early", e, e) for e in (*range(4), *range(500, 600))]
    members = spark.createDataFrame(rows, "tag string, entity int, pos int")
    held = {(t, e) for t, e, _ in rows}
    wanted = {(t, o): sum(u == t and (o, e) in held for u, e, _ in rows) for t in ("a", "late", "early") for o in ("a", "late", "early") if o != t}
    sizes = {t: sum(u == t for u, *_ in rows) for t in ("a", "late", "early")}
    found = {(r["tag"], r["other"]): (r["n"], r["association"]) for r in training.co_tags(members).collect()}
    assert found == {k: (n, n / sizes[k[1]]) for k, n in wanted.items() if n >= 3} and found["a", "late"][0] == 12
    assert ("a", "late") not in {(r["tag"], r["other"]) for r in training.co_tags(members, sample=200).collect()}
    assert training.hard_negatives(members).where("tag = 'a'").orderBy("pool_pos").first()["entity"] == 900


def test_a_training_set_counts_all_picks(spark: SparkSession) -> None:
    """The negatives of tag a come from a tag that shares picks with it only behind the first 200."""
    texts = spark.createDataFrame([(e, 0, f"h{e}", f"text {e}") for e in range(400)], "entity int, fragment int, text_hash string, text string")
    members = spark.createDataFrame([("a", e, e) for e in range(300)] + [("far", e, e) for e in range(250, 270)] + [("far", 399, 399)], "tag string, entity int, pos int")
    tags = spark.createDataFrame([("a", None), ("far", None)], "tag string, description string")
    made = [assemble(texts, members, tags, co_tag_sample=n).triplets.where("tag = 'a'").select("negative").distinct().collect() for n in (None, 200)]
    assert [r["negative"] for r in made[0]] == ["text 399"] and made[1] == []
