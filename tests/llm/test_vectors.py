"""Top-k by the threshold algorithm and near-duplicates by projection trees, against brute force."""

from __future__ import annotations

import os
import threading

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.llm import projection_forest
from fragmill.llm.projection_forest import Tree, near_duplicates, spill_of
from fragmill.llm.threshold_topk import Block, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def test_block_equals_brute_force() -> None:
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, d, big = int(rng.integers(1, 60)), int(rng.integers(1, 6)), 10 ** int(rng.integers(0, 9))
        x, ids, q = rng.integers(-3, 4, (n, d)) * big, rng.permutation(200)[:n], rng.integers(-3, 4, d) * big
        found, scores = Block(ids, x).top(q, int(ids[0]), 5)
        expected = sorted((-sum(int(a) * int(b) for a, b in zip(x[k], q, strict=True)), int(ids[k])) for k in range(1, n))[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, found, strict=True)] == expected


def test_the_scan_stops_early_on_skewed_data() -> None:
    """Where few components are large, the bound falls fast: most of the lists is never read."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.pareto(1.5, (5000, 8)) * 100).astype(np.int64)
    block, wanted = Block(np.arange(len(x)), x), np.floor(rng.pareto(1.5, (20, 8)) * 100).astype(np.int64)
    for q in wanted:
        found, scores = block.top(q, -1, 5)
        expected = sorted((-int(s), i) for i, s in enumerate(x @ q))[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, found, strict=True)] == expected
    assert block.entries_read < 0.1 * len(wanted) * x.size


def test_top_k(spark: SparkSession) -> None:
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(150, 6)), 1).astype(np.float32)
    rows = [(k, [float(v) for v in x], 0, 7) for k, x in enumerate(vectors)]
    bad = [(200, None, 0, 0), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0), (300, [float("nan")] * 6, 0, 0), (350, [float("inf")] * 6, 0, 0), (400, [], 0, 0), (450, [1.0], 0, 0), (7, rows[7][1], 0, 0)]
    table = spark.createDataFrame([*rows, *bad], SCHEMA)
    out = exact_top_k(table, F.col("vec_id") % 50 == 0, k=5, least_blocks=8, query_rows=2).collect()
    q = np.floor(vectors.astype(np.float64) * 256).astype(int)
    q = np.vstack([q, q[7]])
    ids = [*range(150), 7]
    for query in (0, 50, 100):
        expected = sorted((-int(q[j] @ q[query]), ids[j]) for j in range(151) if ids[j] != query)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == query) == [(k + 1, i, -s) for k, (s, i) in enumerate(expected)]
    assert {r["query_id"] for r in out} == {0, 50, 100}
    few_bytes = exact_top_k(table, F.col("vec_id") % 50 == 0, k=5, block_bytes=3_000, least_blocks=1).collect()  # about nine rows a block
    assert sorted(few_bytes) == sorted(out)
    assert exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_top_k(table.where("vec_id in (0, 3, 4)"), F.col("vec_id") % 50 == 0).count() == 2


def brute_force(vectors: list, threshold: float) -> tuple[list[int], list[int]]:
    def usable(v: list | None) -> bool:
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, root = [0] * len(vectors), list(range(len(vectors)))
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if usable(a) and usable(b) and len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return links, root


@pytest.mark.parametrize("leaf_vectors", [16, 1024])
def test_near_duplicates(spark: SparkSession, leaf_vectors: int) -> None:
    rng = np.random.default_rng(3)
    vectors: list = []
    for k in range(40):
        base = rng.normal(size=16)
        vectors += [base + rng.normal(size=16) * 0.05 * (j + 1) for j in range(1 + k % 6)]
    vectors += [vectors[0]] * 30 + [vectors[1] * 4.0]
    # more than a leaf of vectors that no projection tells apart, so that a leaf is compared in several blocks
    vectors += [vectors[0] + rng.normal(size=16) * 1e-4 for _ in range(70)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors] + [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(k, v, 0, 0) for k, v in enumerate(vectors)], SCHEMA)
    rows = {r["vec_id"]: r for r in near_duplicates(table, leaf_vectors=leaf_vectors).collect()}
    links, root = brute_force(vectors, 0.95)
    assert [rows[k]["n_links"] for k in range(len(vectors))] == links
    assert [rows[k]["component_id"] for k in range(len(vectors))] == root
    assert [rows[k]["kept"] for k in range(len(vectors))] == [r == k for k, r in enumerate(root)]
    assert near_duplicates(table.limit(0)).count() == 0


def test_null_and_repeated_ids(spark: SparkSession) -> None:
    rows = near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 0, 0), (4, [1.0, 0.0], 0, 0), (4, [0.0, 1.0], 0, 0), (None, None, 0, 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, 0, -1, True), (-1, 1, 4, False), (4, 0, 4, True), (4, 1, 4, True)]


@pytest.mark.parametrize("components", [64, 256, 768])
def test_recall_and_copies_do_not_depend_on_the_components(components: int) -> None:
    """5,000 pairs just above the threshold: in five trees they meet in some leaf, at few copies of a vector."""
    rng = np.random.default_rng(components)
    left, off = rng.normal(size=(2, 5000, components))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    off -= (off * left).sum(1, keepdims=True) * left
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 0.96, (5000, 1))
    vectors = np.concatenate([left, cosine * left + np.sqrt(1 - cosine**2) * off])
    met, copies = np.zeros(5000, dtype=bool), 0
    for seed in range(5):
        rows, leaves = Tree(vectors[rng.permutation(10_000)[:8192]], 6, seed).leaves(vectors, spill_of(0.95, components))
        copies += len(rows)
        keys = np.unique(rows * 1024 + leaves)
        first, second = keys[keys < 5000 * 1024], keys[keys >= 5000 * 1024] - 5000 * 1024
        met[np.intersect1d(first, second) // 1024] = True
    assert met.mean() >= 0.99 and copies / (5 * 10_000) <= 4
    assert spill_of(0.95, 64) == pytest.approx(0.03, abs=1e-4)


def on_disk(spark: SparkSession) -> int:
    """Bytes of the session's shuffle files and of its tables in the shared folder."""
    folders = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    total = 0
    for top in [*folders, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")]:
        for d, _, names in os.walk(top):
            for name in names:
                try:
                    total += os.path.getsize(f"{d}/{name}")
                except OSError:  # gone meanwhile
                    pass
    return total


def test_disk_stays_in_proportion_to_the_vectors(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Copies for trees, spill and blocks aren't on disk all at once: 6,000 vectors, a third of them one dense group."""
    monkeypatch.setattr(projection_forest, "LEAST_PASS", 0, raising=False)
    monkeypatch.setattr(projection_forest, "BLOCK", 1024, raising=False)
    monkeypatch.setattr(projection_forest, "GROUP_BYTES", 512 * 512, raising=False)  # a dense group is more than a task takes
    rng, n = np.random.default_rng(8), 6_000
    x = rng.normal(size=(n, 64))
    x[: n // 3] = x[0] + 0.01 * rng.normal(size=(n // 3, 64))
    x[n // 2 :: 50] = x[n // 2 - 1 : -1 : 50] * 2 + 0.2 * rng.normal(size=x[n // 2 :: 50].shape)
    x = x[rng.permutation(n)].astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).cache()
    assert table.count() == n
    before, peak, ended = on_disk(spark), [0], threading.Event()
    watch = threading.Thread(target=lambda: [peak.__setitem__(0, max(peak[0], on_disk(spark))) for _ in iter(lambda: ended.wait(0.05), True)])
    watch.start()
    try:
        rows = near_duplicates(table, trees=2, leaf_vectors=256).collect()
    finally:
        ended.set()
        watch.join()
        table.unpersist()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.95).sum(1) - 1 for k in range(0, n, 1000)])
    assert links.max() == n // 3 - 1 and [r["n_links"] for r in sorted(rows)] == links.tolist()
    assert peak[0] - before <= 4 * x.nbytes, (peak[0] - before) / x.nbytes
