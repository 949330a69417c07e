"""Clustering by kd-tree filtering, against plain rounds over all vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import SparkSession

from fragmill.llm.kd_clustering import Tree, cluster

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int"


def plain(x: np.ndarray, ids: list, clusters: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = sorted(range(len(x)), key=lambda k: (hashlib.sha256(f"3:{'' if ids[k] is None else ids[k]}".encode()).hexdigest(), x[k].tolist()))
    centroids = x[order[:clusters]].copy()
    for _ in range(rounds + 1):
        distance = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        best = distance.argmin(1)
        last = centroids.copy()
        for k in range(len(centroids)):
            if (best == k).any():
                centroids[k] = x[best == k].sum(0) // (best == k).sum()
    return best, distance[np.arange(len(x)), best], last


@pytest.mark.parametrize("leaf", [1, 4, 1000])
@pytest.mark.parametrize("spread", [3, 1000, 2**24])
def test_a_tree_equals_comparing_all(leaf: int, spread: int) -> None:
    """With spread 3 many distances are equal, so the smaller number must win whichever way the tree decides."""
    rng = np.random.default_rng(spread + leaf)
    for _ in range(25):
        x, c = rng.integers(-spread, spread + 1, (int(rng.integers(1, 200)), 3)), rng.integers(-spread, spread + 1, (int(rng.integers(1, 9)), 3))
        tree, order = Tree.grown(x, leaf)
        distance = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        best, found = tree.assigned(c)
        assert best.tolist() == distance.argmin(1)[order].tolist() and found.tolist() == distance.min(1)[order].tolist()
        counts, sums = tree.totals(c)
        assert counts.tolist() == np.bincount(distance.argmin(1), minlength=len(c)).tolist()
        assert sums.tolist() == [x[distance.argmin(1) == k].sum(0).tolist() for k in range(len(c))]


def test_whole_nodes_are_assigned_and_centroids_pruned() -> None:
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 3, (500, 4)).astype(np.int64) for m in (0, 1000, 5000, 9000)])
    found = list(Tree.grown(x, 8)[0].filtered(np.array([[m] * 4 for m in (0, 1000, 5000, 9000)])))
    assert all(whole for _, whole, _ in found) and len(found) < 12


def test_clusters(spark: SparkSession) -> None:
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.4, (60, 64)) for m in (-1, 0, 0.2, 1)]).astype(np.float32)
    x = np.concatenate([x, x[:40]])  # repeated vectors of other ids
    ids: list = [*range(len(x) - 2), 5, None]  # a repeated and a null id
    good = [(i, [float(v) for v in r], 0, "x", 1) for i, r in zip(ids, x, strict=True)]
    bad = [(900, None, 0, "", 0), (901, [], 0, "", 0), (902, [1.0] * 63, 0, "", 0), (903, [1.0] * 63 + [None], 0, "", 0), (904, [float("nan")] * 64, 0, "", 0), (905, [float("-inf")] * 64, 0, "", 0), (906, [1.0] * 65, 0, "", 0)]
    table = spark.createDataFrame(good + bad, SCHEMA).repartition(3)
    rows = cluster(table, tree_rows=50, leaf=4).collect()
    n = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    best, distance, last = plain(n, ids, 8, 10)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    inertia = [int(distance[best == k].sum()) for k in range(8)]
    expected = [(i, int(b), int(d), inertia[b], int(distance.sum()), names[b]) for i, b, d in zip(ids, best, distance, strict=True)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))


def test_few_vectors_and_none(spark: SparkSession) -> None:
    table = spark.createDataFrame([(k, [float(k)] * 64, 0, "", 0) for k in range(3)], SCHEMA)
    assert sorted(r["distance"] for r in cluster(table).collect()) == [0, 0, 0]
    assert {r["cluster"] for r in cluster(table).collect()} == {0, 1, 2}
    empty = cluster(table.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = cluster(spark.createDataFrame([(7, [0.5] * 64, 0, "", 0)] * 20, SCHEMA)).collect()
    assert {r["cluster"] for r in same} == {0} and len(same) == 20
    with pytest.raises(Exception, match="don't fit a long"):
        cluster(spark.createDataFrame([(1, [1e6] * 64, 0, "", 0)], SCHEMA)).collect()
