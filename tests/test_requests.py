"""Symbols, the request codec, and models that go through the store to workers."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.functions.symbols import is_known_symbol, symbol_parts
from fragmill.operators import codec
from fragmill.sources.models import Models
from fragmill.sources.snapshot import SnapshotStore


def test_symbols(spark: SparkSession) -> None:
    known = "{W} {t} {20} {07} {0} {W/U} {2/w} {g/u/p} {WU} {wup} {222} {1/2} {100} {TK} {infinity} {p}".split()
    unknown = "{} {21} {99} {H} {W/U/B/R} {W/} {k/w} {wubr} {22} {wx} W {{W}} {w}x".split() + ["", None]
    rows = spark.createDataFrame([(s,) for s in known + unknown], "s string").select("s", is_known_symbol(F.col("s")).alias("k")).collect()
    assert [r["k"] for r in rows] == [True] * len(known) + [False] * len(unknown)
    parts = spark.createDataFrame([("{T}: Add {G}{G}.",), ("none",), ("",), ("{x",)], "s string").select(symbol_parts(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in parts] == [["{T}", ": Add ", "{G}", "{G}", "."], ["none"], [], ["{x"]]


def request(**have: object) -> tuple:
    names = ["query", "entity_id", "facet_ix", "include", "exclude", "categories", "formats", "rarities", "colors", "color_mode", "color_feature", "cmc_min", "cmc_max"]
    return tuple(have.get(n) for n in names)


def test_codec(spark: SparkSession) -> None:
    cases = [
        (request(query=" draw a card & 100% ~x* "), "q=draw+a+card+%26+100%25+%7Ex*"),
        (request(query="q", entity_id="e 1", facet_ix=1, include=[3, 1, 3, -1], exclude=[1, 2]), "card=e+1&exc=2&face=1&inc=1%2C3"),
        (request(categories=["land", "odd", " land ", "creature"], formats=["modern"], rarities=["rare", "common", "x"], colors="WU"), "colors=WU&format=m&rarity=common%2Crare&type=lc"),
        (request(color_mode="at_least", color_feature="identity", cmc_min=2.0, cmc_max=2.5), "cmcMax=2.5&cmcMin=2"),
        (request(color_mode="exact", color_feature="colors", cmc_max=float("nan"), facet_ix=2, include=[1]), "colorBy=colors&match=exact"),
        (request(query="  ", entity_id="", categories=[], colors=""), ""),
    ]
    rows = spark.createDataFrame([(r,) for r, _ in cases], f"r {codec.REQUEST}").select("r", codec.encoded(F.col("r")).alias("url"), codec.normalized(F.col("r")).alias("n"))
    rows = rows.withColumn("back", codec.decoded(F.col("url"))).withColumn("again", codec.encoded(F.col("back"))).collect()
    assert [r["url"] for r in rows] == [url for _, url in cases]
    assert all(r["back"] == r["n"] and r["again"] == r["url"] for r in rows)
    odd = spark.createDataFrame([("x=1&type=cqc&q=%zz&cmcMin=abc&match=none&face=2",), ("card=e&inc=2,a,-1,0&exc=0,5&inc=7",)], "u string").select(codec.encoded(codec.decoded(F.col("u"))).alias("u")).collect()
    assert [r["u"] for r in odd] == ["type=c", "card=e&exc=5&inc=0%2C2"]


def test_a_model_goes_through_upload_promotion_and_encoding(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    def load(folder: str):  # noqa: ANN202
        table = np.load(f"{folder}/weights/table.npy")
        return lambda texts: [table[len(t) % len(table)].tolist() for t in texts]

    table = np.random.default_rng(2).normal(size=(7, 3)).astype(np.float32)
    (tmp_path / "local/weights").mkdir(parents=True)
    np.save(tmp_path / "local/weights/table.npy", table)
    (tmp_path / "local/config.json").write_text("{}")
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=2)
    models, put = Models(store), store.put_file
    monkeypatch.setattr(store, "put_file", lambda path, name: (_ for _ in ()).throw(OSError("lost")) if name.endswith(".npy") else put(path, name))
    with pytest.raises(OSError, match="lost"):
        models.upload(tmp_path / "local", "m1")
    assert not models.has("m1")  # cut off: no list of files
    monkeypatch.undo()
    models.upload(tmp_path / "local", "m1")
    assert models.has("m1") and not models.has("m2")
    with pytest.raises(FileExistsError):
        models.upload(tmp_path / "local", "m1")
    with pytest.raises(FileNotFoundError):
        models.download("m2", tmp_path / "cache")
    folder = models.download("m1", tmp_path / "cache")
    assert np.array_equal(np.load(folder / "weights/table.npy"), table) and not list(folder.rglob("*.part"))
    before = (folder / "weights/table.npy").stat().st_mtime_ns
    assert (models.download("m1", tmp_path / "cache") / "weights/table.npy").stat().st_mtime_ns == before
    store.promote("m1")
    terms = spark.createDataFrame([("a", "draw"), ("b", "gain it"), ("c", "")], "text_hash string, normalized string")
    store.publish({"terms": terms}, terms, models.encoder(store.promoted(), load), "v1", datetime(2024, 1, 1, tzinfo=UTC))
    assert store.current()["model"] == "m1"
    found = {r["text_hash"]: r["vector"] for r in store.table("vectors").collect()}
    assert all(np.allclose(found[h], table[len(t) % 7]) for h, t in (("a", "draw"), ("b", "gain it"), ("c", "")))
