"""Datasets, evaluation by the search, pointers, line order, sitemaps and token models."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.functions.exprs import scan_map
from fragmill.operators import dataset, evaluate, retrieval
from fragmill.operators.batch import score_queries
from fragmill.operators.encode import ArrowEncoder, HashingEncoder, mean_pool, token_model
from fragmill.operators.fragments import fragments, terms
from fragmill.operators.index import with_idf, with_vectors
from fragmill.sources.sitemap import read_sitemap, write_sitemap
from fragmill.sources.snapshot import Follower, SnapshotStore
from fragmill.sources.tables import merge_cache, read_query_cache, read_records, read_tags


def test_fragment_queries_equal_plain_search(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    facets = {k: rng.normal(size=(rng.integers(1, 4), 5)) for k in range(60)}
    asked = {q: [rng.normal(size=(rng.integers(1, 4), 5)) for _ in range(rng.integers(1, 4))] for q in range(9)}
    popular = {k: [None, 0, 5, 7][k % 4] for k in facets}
    facets[59] = facets[3]  # a tie in score
    known = spark.createDataFrame([(k, v.tolist()) for k, vs in facets.items() for v in vs], "facet long, vector array<double>")
    queries = spark.createDataFrame([(q, f, v.tolist()) for q, fs in asked.items() for f, vs in enumerate(fs) for v in vs], "query_id long, fragment int, vector array<double>")
    ranks = spark.createDataFrame(list(popular.items()), "facet long, popularity int")
    found = score_queries(known, queries, ranks, 7, block_rows=20, query_rows=6).collect()
    for q, fs in asked.items():
        score = {k: np.mean([max(float(a @ b) for a in f for b in vs) for f in fs]) for k, vs in facets.items()}
        order = sorted(score, key=lambda k: (-np.floor(score[k] * 1e4 + 0.5), popular[k] or np.inf, k))[:7]
        assert [r["facet"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_models_are_evaluated_through_the_search(spark: SparkSession) -> None:
    names = [("fly", "Flying high"), ("dig", "Dig a deep hole"), ("swim", "Swim over the lake"), ("run", "Run to the hill")]
    rows = [(f"{tag}{k}", 0, "X", "Creature", f"{text} {k}.") for tag, text in names for k in range(5)]
    built = fragments(spark.createDataFrame(rows, "entity_id string, facet_ix int, name string, type_line string, text string"), set(), {})
    encoders = {"served": HashingEncoder(128), "candidate": HashingEncoder(2)}
    models = {name: (with_vectors(with_idf(built, "text_hash"), e.encode(terms(built))), e) for name, e in encoders.items()}
    entities = built.select("entity_id", F.lit(None).cast("int").alias("rank")).distinct()
    tags = spark.createDataFrame([(f"{tag}-{n}", text) for tag, text in names for n in range(12)], "tag string, description string")
    members = spark.createDataFrame([(f"{tag}-{n}", f"{tag}{k}") for tag, _ in names for n in range(12) for k in (*range(5), 99)], "tag string, entity string")
    said = spark.createDataFrame([("over the lake", "swim-1"), ("nothing", "no-tag")], "phrase string, tag string")
    queries, gold = evaluate.evaluation_queries(tags, members, entities, said, low=2)
    asked = {(r["kind"], r["tag"]) for r in queries.collect()}
    held = {t for r in tags.where(dataset.held_out(F.col("tag"))).collect() for t in [r["tag"]]}
    assert held and {t for _, t in asked} == held and {k for k, _ in asked} >= {"name", "described"}
    assert gold.groupBy("query_id").count().select("count").distinct().first()[0] == 5  # the unknown entity is no gold
    assert evaluate.evaluation_queries(tags, members, entities)[0].isEmpty()  # five entities are too few for a tag
    figures = {(r["model"], r["kind"]): r for r in retrieval.compare_models(queries, gold, models, entities).collect()}
    assert figures["served", "described"]["mrr"] == 1.0 and figures["served", "described"]["p_at_10"] == pytest.approx(0.5)
    assert figures["candidate", "all"]["queries"] == len(asked) and figures["candidate", "described"]["mrr"] <= 1.0


def test_assembly(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    texts = spark.createDataFrame([(k, 0, f"h{k}", f"word{k} thing") for k in range(60)], "entity long, fragment int, text_hash string, text string")
    tags = spark.createDataFrame([(f"t{n}", "says it") for n in range(6)], "tag string, description string")
    members = spark.createDataFrame([(f"t{n}", k, k) for n in range(6) for k in range(60) if k % (n + 2) == 0], "tag string, entity long, pos long")
    cache = spark.createDataFrame([("h1", "x", ["q one", "q two"], "m"), ("gone", "y", ["q"], "m")], "hash string, text string, queries array<string>, llm string")
    made = dataset.assemble(texts, members, tags, cache)
    kinds = {r["kind"]: r["count"] for r in made.pairs.groupBy("kind").count().collect()}
    assert kinds["self"] == 60 and kinds["llm"] == 2
    own = {(r["tag"], r["text"]) for r in members.join(texts, "entity").select("tag", "text").collect()}
    found = made.triplets.collect()
    assert found and all((r["tag"], r["positive"]) in own and (r["tag"], r["negative"]) not in own for r in found)
    stats = made.stats.first()
    assert (stats["fragments"], stats["texts"], stats["pairs"], stats["triplets"]) == (60, 60, sum(kinds.values()), len(found))
    made.write(str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set/pairs")).count() == stats["pairs"]
    only = dataset.assemble(texts, members, tags, augment=())
    assert only.pairs.count() == 60 and only.triplets.isEmpty()
    with pytest.raises(ValueError, match="unknown augmentation"):
        dataset.assemble(texts, members, tags, augment=("more",))


def test_stages_stop_at_the_first_failure() -> None:
    ran: list[str] = []
    assert dataset.run_stages([("a", lambda: ran.append("a")), ("b", lambda: ran.append("b"))]) == ["a", "b"]
    with pytest.raises(RuntimeError, match="'bad' failed after a"):
        dataset.run_stages([("a", lambda: None), ("bad", lambda: 1 / 0), ("c", lambda: ran.append("c"))])
    assert ran == ["a", "b"]


def test_pointer_is_replaced_in_one_step(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path))
    for k in range(3):
        store.write_json("current.json", {"k": k})
        assert store.read_json("current.json") == {"k": k}
    assert store.exists("current.json") and not store.exists("models/m1")
    (tmp_path / ".current.json.part").mkdir()  # the new file can't be written: the old one stays
    with pytest.raises(Exception, match="."):
        store.write_json("current.json", {"k": 9})
    assert store.read_json("current.json") == {"k": 2}


def test_sources_with_errors_and_polling(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store = SnapshotStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="no snapshot"):
        store.source()
    with pytest.raises(FileNotFoundError):
        store.source(path=str(tmp_path / "none"))
    rows = spark.createDataFrame([("b", "gain"), ("a", "draw")], "text_hash string, normalized string")
    store.publish({"facets": rows}, rows, HashingEncoder(4), "v1")
    table, where = store.source()
    assert table.count() == 2 and where.startswith("snapshot ")
    with pytest.raises(FileNotFoundError, match="has no other"):
        store.source("other")
    follower = Follower(store, ["facets"])
    assert follower.poll()
    store.write_json("current.json", {"snapshot": "broken", "model": "m", "version": "v"})
    with pytest.raises(Exception, match="."):
        follower.poll()
    assert follower.tables["facets"].count() == 2  # what was served is still there


def test_order_of_lines_over_several_files(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """The larger file is planned first, but the later file's line counts."""
    old = [{"hash": "h", "text": "old", "queries": ["a"], "llm": "m"}, *({"hash": f"x{k}", "text": "t" * 200, "queries": [], "llm": "m"} for k in range(500))]
    (tmp_path / "b1.json").write_text("\n".join(json.dumps(r) for r in [{"hash": "h", "text": "new", "queries": ["b"], "llm": "m"}]))
    (tmp_path / "a0.json").write_text("\n".join(json.dumps(r) for r in old))
    found = read_query_cache(spark, str(tmp_path)).where("hash = 'h'").collect()
    assert [r["text"] for r in found] == ["new"]
    (tmp_path / "r").mkdir()
    with gzip.open(tmp_path / "r/2.json.gz", "wt") as f:
        f.write(json.dumps({"id": "late", "oracle_id": "o"}))
    (tmp_path / "r/1.json").write_text("\n".join(json.dumps({"id": f"early{k}", "oracle_id": "o"}) for k in range(3)))
    assert [r["id"] for r in read_records(spark, str(tmp_path / "r")).orderBy("ordinal").collect()] == ["early0", "early1", "early2", "late"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.json").write_text(json.dumps({"label": "t", "description": "old" * 900, "taggings": []}))
    (tmp_path / "t/2.json").write_text(json.dumps({"label": "t", "description": "new", "taggings": []}))
    assert read_tags(spark, str(tmp_path / "t"))[0].first()["description"] == "new"


def test_merged_cache_keeps_its_own(spark: SparkSession) -> None:
    kind = "hash string, text string, queries array<string>, llm string"
    own, other = spark.createDataFrame([("a", "x", ["q"], "own")], kind), spark.createDataFrame([("a", "x", ["r"], "other"), ("b", "y", ["s"], "other"), ("c", "z", ["t"], "other")], kind)
    wanted = spark.createDataFrame([("a",), ("b",)], "text_hash string")
    assert {(r["hash"], r["llm"]) for r in merge_cache(own, other, wanted).collect()} == {("a", "own"), ("b", "other")}


def test_sitemap_file(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    ids = spark.createDataFrame([("b&c",), ("a<",), ("a<",)], "entity_id string")
    write_sitemap(ids, str(tmp_path / "s"), "https://x.y")
    assert [r["loc"] for r in read_sitemap(spark, str(tmp_path / "s")).collect()] == ["https://x.y/", "https://x.y/?entity=a&lt;", "https://x.y/?entity=b&amp;c"]


def test_token_models_pool_what_the_mask_holds(spark: SparkSession) -> None:
    table = np.random.default_rng(1).normal(size=(50, 4))

    def load():  # noqa: ANN202
        return token_model(lambda texts: [[len(w) for w in t.split()] for t in texts], lambda ids, mask: table[ids], max_tokens=3)

    rows = spark.createDataFrame([("h1", "a bb ccc dddd"), ("h2", "ee"), ("h3", "")], "text_hash string, normalized string")
    out = {r["text_hash"]: r["vector"] for r in ArrowEncoder("t", load).encode(rows).collect()}
    mean = table[[1, 2, 3]].mean(0)
    assert np.allclose(out["h1"], mean / np.linalg.norm(mean), atol=1e-6) and np.allclose(out["h2"], table[2] / np.linalg.norm(table[2]), atol=1e-6)
    assert set(out["h3"]) == {0.0}
    native = spark.range(1).select(mean_pool(F.array(*(F.array(*(F.lit(float(x)) for x in table[k])) for k in (1, 2, 3, 4))), F.array(*map(F.lit, (1, 1, 1, 0))))).first()[0]
    assert np.allclose(native, mean / np.linalg.norm(mean))


def test_scan_map_on_odd_texts(spark: SparkSession) -> None:
    texts = ["", "12", "a1b22", "1\n2", "x\x01y 3", "none", "7$1\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan_map(F.col("t"), r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("o")).collect()
    assert [r["o"] for r in rows] == ["", "<12>", "a<1>b<22>", "<1>\n<2>", "x y <3>", "none", "<7>$<1>\\"]
