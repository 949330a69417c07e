"""Lines in order, the streaming fold, exactly-once batches, the server and counts in passing."""

from __future__ import annotations

import gzip
import json
import random
import time
import tracemalloc
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.operators import dataset, records
from fragmill.operators.encode import HashingEncoder
from fragmill.operators.serving import Server
from fragmill.sources.lines import LineReader, numbered, read_json_lines, read_lines
from fragmill.sources.snapshot import SnapshotStore
from fragmill.streaming.batch_log import BatchLog
from fragmill.streaming.refresh import read_vectors, stream_new_vectors


def lines_of(path: Path, split: int) -> list[tuple[int, int, str]]:
    reader, out = LineReader(str(path), split), []
    for part in reader.partitions():
        for batch in reader.read(part):
            out += zip([part.start] * batch.num_rows, batch.column("line").to_pylist(), batch.column("value").to_pylist(), strict=True)
    return out


def test_every_line_is_read_once_wherever_parts_are_cut(tmp_path: Path) -> None:
    random.seed(4)
    for k in range(60):
        lines = ["é" * random.randint(0, 12) + str(n) * (n % 3) for n in range(random.randint(0, 30))]
        body = ("\n".join(lines) + "\n" * random.randint(0, 2)).encode()
        plain, packed = tmp_path / f"{k}.json", tmp_path / f"{k}.json.gz"
        plain.write_bytes(body)
        cuts = sorted(random.choices(range(len(body) + 1), k=6))  # members that end within lines, and empty ones
        packed.write_bytes(b"".join(gzip.compress(body[a:b]) for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)))
        for path in (plain, packed):
            for split in (1, 2, 7, 40, 10**6):
                found = lines_of(path, split)
                assert [v for _, _, v in found] == body.decode().removesuffix("\n").split("\n")[: None if body else 0] and found == sorted(found)


def test_a_large_gzip_of_many_members_is_read_in_parts(spark: SparkSession, tmp_path: Path) -> None:
    random.seed(5)
    rows = [json.dumps({"id": n, "x": random.random()}) for n in range(30_000)]
    body = ("\n".join(rows)).encode()
    (tmp_path / "a.json.gz").write_bytes(b"".join(gzip.compress(body[k : k + 100_001]) for k in range(0, len(body), 100_001)))
    (tmp_path / "b.json").write_text("{\"id\": -1}\r\n\r\nbroken\n")
    assert read_lines(spark, str(tmp_path / "a.json.gz"), 50_000).select("start").distinct().count() > 5
    found = read_json_lines(spark, f"file://{tmp_path}", "id long", split=50_000).orderBy("ordinal").collect()
    assert [r["id"] for r in found] == [*range(30_000), -1, None]
    assert [r["number"] for r in numbered(read_lines(spark, str(tmp_path / "a.json.gz"), 50_000)).orderBy("file", "start", "line").collect()] == list(range(30_000))
    assert [r["number"] for r in numbered(read_lines(spark, str(tmp_path / "b.json"), 4)).orderBy("number").collect()] == [0, 1, 2]
    truncated = tmp_path / "c.json.gz"
    truncated.write_bytes(gzip.compress(body)[:5000])
    with pytest.raises(EOFError):
        lines_of(truncated, 10**6)
    with pytest.raises(FileNotFoundError):
        LineReader(str(tmp_path / "none"), 10).partitions()


def plain_fold(rows: list[tuple]) -> dict:
    """The rule, record by record."""
    best: dict = {}

    def number(x: str) -> int | None:
        return int(x) if x.isdigit() else None

    for entity, order, paper, date, n in rows:
        date, n = date or "9999-99-99", n or "zzzz"
        if entity in best:
            _, paper0, date0, n0 = best[entity]
            if paper != paper0:
                better = paper
            elif date != date0:
                better = date < date0
            else:
                better = number(n) < number(n0) if number(n) is not None and number(n0) is not None else n < n0
            if not better:
                continue
        best[entity] = (order, paper, date, n)
    return {e: b[0] for e, b in best.items()}


def test_the_fold_equals_the_rule_record_by_record(spark: SparkSession) -> None:
    """Numbers 10, 9a and 9 beat each other in a circle, so the order of the records decides."""
    random.seed(6)
    rows = [(random.choice("abcdef"), k, random.random() < 0.5, random.choice(["2001-01-01", "2002-01-01", "", None]), random.choice(["10", "9", "9a", "10b", "2", "", None, "x"])) for k in range(3000)]
    rows += [("hot", 3000 + k, True, "2001-01-01", random.choice(["10", "9a", "9"])) for k in range(2000)]
    table = spark.createDataFrame(rows, "oracle_id string, ordinal long, paper boolean, released_at string, collector_number string").repartition(7)
    table = table.withColumn("games", F.when(F.col("paper"), F.array(F.lit("paper")))).withColumn("payload", F.col("ordinal")).drop("paper")
    found = records.best_records(table)
    assert "ordinal" not in found.columns and {r["oracle_id"]: r["payload"] for r in found.collect()} == plain_fold(rows)


def test_the_fold_holds_one_record() -> None:
    """A million records of one entity go through in batches without being kept."""

    def batches() -> Iterator[pa.RecordBatch]:
        for k in range(100):
            n = list(range(1_000_000 - k * 10_000, 1_000_000 - (k + 1) * 10_000, -1))
            yield pa.RecordBatch.from_arrays([pa.array(["e"] * 10_000), pa.array(n), pa.array(n), pa.array(list(map(str, n)))], ["oracle_id", "_order", "_n", "_number"])

    tracemalloc.start()
    found = list(records._fold(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.to_pylist() for b in found] == [[{"oracle_id": "e", "_order": 1}]] and peak < 30e6


TERMS = "text_hash string, normalized string"


@pytest.mark.parametrize("lost", ["data", "manifest"])
def test_a_batch_that_was_cut_off_counts_once(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch, lost: str) -> None:
    source, vectors, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", "draw"), ("b", "gain")], TERMS).write.parquet(source)
    write, fail = SnapshotStore.write_json, [True]

    def cut(self: SnapshotStore, name: str, value: dict) -> None:
        if fail and name.startswith("manifests/"):
            fail.clear()
            if lost == "manifest":  # or else the manifest is there, and the stream's own commit is what is lost
                raise OSError("lost")
            write(self, name, value)
            raise OSError("lost")
        write(self, name, value)

    monkeypatch.setattr(SnapshotStore, "write_json", cut)
    with pytest.raises(Exception, match="lost"):
        stream_new_vectors(spark, source, vectors, state, HashingEncoder(8))
    assert read_vectors(spark, vectors, HashingEncoder(8)).count() == (2 if lost == "data" else 0)
    assert stream_new_vectors(spark, source, vectors, state, HashingEncoder(8)) == 2
    spark.createDataFrame([("b", "gain"), ("c", "tap")], TERMS).write.mode("append").parquet(source)
    assert stream_new_vectors(spark, source, vectors, state, HashingEncoder(8)) == 1
    assert sorted(r["text_hash"] for r in read_vectors(spark, vectors, HashingEncoder(8)).collect()) == ["a", "b", "c"]
    # another stream's first batch has the same number, and another model encodes everything
    assert stream_new_vectors(spark, source, vectors, str(tmp_path / "state2"), HashingEncoder(8)) == 0
    assert stream_new_vectors(spark, source, vectors, str(tmp_path / "state3"), HashingEncoder(4)) == 3
    log = BatchLog(spark, vectors, "text_hash string, vector array<float>")
    assert log.compact(model="hashing-8") and log.compact(model="hashing-8") is None
    assert read_vectors(spark, vectors, HashingEncoder(8)).count() == 3 and read_vectors(spark, vectors, HashingEncoder(4)).count() == 3


def publish(spark: SparkSession, store: SnapshotStore, day: int, name: str, dimension: int = 16) -> None:
    fragments = spark.createDataFrame([("e", 0, 0, "Flying", "flying.", "h1", 1.0)], "entity_id string, facet_ix int, fragment_ix int, text string, normalized string, text_hash string, idf double")
    entities = spark.createDataFrame([("e", "r", name, "normal", 1.0, 1, "rare", None, "s", "b", "W", None)], "entity_id string, record_id string, name string, layout string, cmc double, rank int, rarity string, legalities map<string,string>, set_code string, border_color string, identity string, keywords array<string>")
    facets = spark.createDataFrame([("e", 0, name, "Creature", "t", ["creature"], ["W"], None, None, None)], "entity_id string, facet_ix int, name string, type_line string, text string, categories array<string>, colors array<string>, mana_cost string, power string, toughness string")
    store.publish({"entities": entities, "facets": facets, "fragments": fragments}, fragments.select("text_hash", "normalized"), HashingEncoder(dimension), f"v{day}", datetime(2024, 1, day, tzinfo=UTC))


def test_a_server_follows_and_survives(spark: SparkSession, tmp_path: Path) -> None:
    store, loaded = SnapshotStore(spark, str(tmp_path), buckets=1), []

    def encoder_of(model: str) -> HashingEncoder:
        loaded.append(model)
        return HashingEncoder(int(model.removeprefix("hashing-")))

    with pytest.raises(FileNotFoundError):
        Server(store, encoder_of)
    publish(spark, store, 1, "First")
    server = Server(store, encoder_of, seconds=0.2).start()

    def until(happened) -> None:  # noqa: ANN001
        end = time.monotonic() + 60
        while not happened() and time.monotonic() < end:
            time.sleep(0.1)
        assert happened()

    try:
        first = server.engine
        assert first.search("flying").first()["name"] == "First"
        good = store.current()
        store.write_json("current.json", {**good, "snapshot": "broken"})
        until(lambda: server.failures > 0)
        assert server.engine is first and first.search("flying").first()["name"] == "First"
        store.write_json("current.json", good)
        publish(spark, store, 2, "Second")
        until(lambda: server.engine is not first)
        assert server.engine.search("flying").first()["name"] == "Second" and loaded == ["hashing-16"]
        assert first.search("flying").first()["name"] == "First"  # a request that began on the old engine ends on it
        publish(spark, store, 3, "Third", dimension=8)
        until(lambda: server.snapshot == store.current()["snapshot"])
        assert loaded == ["hashing-16", "hashing-8"] and server.engine.search("flying").first()["name"] == "Third"
    finally:
        server.stop()


def test_counts_come_with_the_write(spark: SparkSession, tmp_path: Path) -> None:
    texts = spark.createDataFrame([(k, 0, f"h{k}", f"word{k} thing") for k in range(20)], "entity long, fragment int, text_hash string, text string")
    tags = spark.createDataFrame([("t", "says it")], "tag string, description string")
    cache = spark.createDataFrame([("h1", "x", ["q one", "q two"], "m")], "hash string, text string, queries array<string>, llm string")
    made = dataset.assemble(texts, texts.select(F.lit("t").alias("tag"), "entity", F.col("entity").alias("pos")), tags, cache, augment=("llm_queries",))
    reads, seen = spark.sparkContext.accumulator(0), made.pairs

    def counted(batches):  # noqa: ANN001, ANN202
        for b in batches:
            reads.add(b.num_rows)
            yield b

    made.pairs = seen.mapInArrow(counted, seen.schema)
    assert made.write(str(tmp_path)) == {"pairs": 22, "llm_pairs": 2, "triplets": 0} and reads.value == 22
    row = spark.read.parquet(f"{tmp_path}/stats").first()
    assert (row["fragments"], row["texts"], row["pairs"], row["llm_pairs"], row["triplets"]) == (20, 20, 22, 2, 0)


def test_a_run_goes_on_where_it_failed(spark: SparkSession, tmp_path: Path) -> None:
    store, ran, broken = SnapshotStore(spark, str(tmp_path)), [], [True]

    def second() -> None:
        if broken:
            broken.clear()
            raise OSError("no")
        ran.append("b")

    stages = [("a", lambda: ran.append("a")), ("b", second), ("c", lambda: ran.append("c"))]
    with pytest.raises(RuntimeError, match="'b' failed after a"):
        dataset.run_stages(stages, store, "m1")
    assert dataset.run_stages(stages, store, "m1") == ["a", "b", "c"] and ran == ["a", "b", "c"]
    assert dataset.run_stages(stages, store, "m1") == ["a", "b", "c"] and len(ran) == 3
    with pytest.raises(ValueError, match="aren't the first"):
        dataset.run_stages(stages[1:], store, "m1")
