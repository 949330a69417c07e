"""Connected components of chains, stars and random graphs, and chains through the operators that use them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from fragmill.llm import components as module
from fragmill.llm.projection_forest import near_duplicates


def plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {x: x for e in edges for x in e}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["ascending", "random", "star", "graph"])
def test_roots_in_few_rounds(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, kind: str) -> None:
    rng = np.random.default_rng(3)
    names = np.arange(500) if kind == "ascending" else rng.permutation(500)
    edges = [(int(names[k]), int(names[k + 1])) for k in range(499)]
    if kind == "star":
        edges = [(499, k) for k in range(499)] + [(600, 601), (601, 602)]
    if kind == "graph":
        edges = [(int(a), int(b)) for a, b in rng.integers(0, 700, (500, 2)) if a != b]
    tables: list[str] = []
    settle = module.settle
    monkeypatch.setattr(module, "settle", lambda df, name: (tables.append(name), settle(df, name))[1])
    found = module.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == plain(edges)
    rounds = tables.count("edges") - 1
    assert rounds <= (1 if kind == "ascending" else 8) and len(tables) <= 45


def test_a_chain_of_vectors_is_one_component(spark: SparkSession) -> None:
    """Each vector is close to the next one only."""
    angle = np.arange(300) * np.arccos(0.96)
    vectors = np.stack([np.cos(angle), np.sin(angle)], 1)
    # a spiral in eight dimensions: far turns don't meet again
    spread = np.concatenate([np.sqrt(0.5) * vectors, np.sqrt(0.5) * np.stack([np.cos(angle * 0.37), np.sin(angle * 0.37)], 1)], 1)
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(spread)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in near_duplicates(table).collect()}
    unit = spread / np.linalg.norm(spread, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    roots = plain([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    assert [rows[k]["n_links"] for k in range(300)] == linked.sum(1).tolist()
    assert [rows[k]["component_id"] for k in range(300)] == [roots.get(k, k) for k in range(300)]
