"""Ranking in parts, and figures of queries that share their gold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from fragmill.operators import batch, evaluate


@pytest.mark.parametrize("product", [1, 60, 4_000_000])
def test_best_in_parts_is_the_brute_force(product: int, monkeypatch: pytest.MonkeyPatch) -> None:
    """Facets of several instances that part limits cut, ties, variants and popularity; what is kept is reduced again and again."""
    import pyarrow as pa

    monkeypatch.setattr(batch, "PRODUCT", product)
    monkeypatch.setattr(batch, "FOUND", 10)
    rng = np.random.default_rng(5)
    facets = np.sort(rng.integers(0, 40, 120))
    vectors, asked = rng.integers(-2, 3, (120, 4)).astype(float), rng.integers(-2, 3, (9, 4)).astype(float)
    query, fragment = [0, 0, 0, 1, 1, 2, 2, 2, 2], [0, 0, 1, 0, 1, 0, 1, 2, 2]
    popular = {f: (None if f % 3 == 0 else float(f % 4 + 1)) for f in range(40)}
    best = batch._Best(5, lambda x: np.floor(x * 1e4 + 0.5) / 1e4)
    best.ask(pa.table({"query_id": query, "fragment": fragment, "vector": pa.array(asked.tolist())}))
    best.hold(pa.table({"facet": facets, "vector": pa.array(vectors.tolist()), "popularity": pa.array([popular[f] for f in facets.tolist()], pa.float64())}))
    found = [(q.as_py(), f.as_py()) for part in best.found() for q, f in zip(part[0], part[1], strict=True)]
    sims, wanted = asked @ vectors.T, []
    for q in range(3):
        rows = []
        for f in sorted(set(facets.tolist())):
            of = [max(sims[k, facets == f].max() for k in range(9) if (query[k], fragment[k]) == (q, g)) for g in sorted({g for p, g in zip(query, fragment, strict=True) if p == q})]
            rows.append((-np.floor(np.mean(of) * 1e4 + 0.5), popular[f] or np.inf, f))
        wanted += [(q, f) for *_, f in sorted(rows)[:5]]
    assert found == wanted


def test_tasks_sort_one_pair_of_blocks(spark: SparkSession) -> None:
    """As many partitions as pairs of blocks, so what a task sorts doesn't grow with the tables."""
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(200)], "entity_id long, vector array<float>")
    asked = rows.selectExpr("entity_id AS query_id", "vector")
    ranked = batch.rank_facets(rows, asked, 3, block_rows=20, query_rows=40)
    assert "RepartitionByExpression [model#" in (plan := ranked._jdf.queryExecution().logical().toString()) and "], 50" in plan
    assert ranked.count() == 600


def test_shared_gold_makes_no_pairs(spark: SparkSession) -> None:
    ranked = spark.createDataFrame([(q, e, e + 1) for q in range(6) for e in range(30) if (q + e) % 4], "query_id int, entity_id int, rank int")
    asked = spark.createDataFrame([(q, q % 3) for q in range(7)], "query_id int, label int")
    members = spark.createDataFrame([(e % 3, e) for e in range(40) if e % 3 != 2 or e > 35] * 2, "label int, entity_id int")
    gold = asked.join(members, "label").select("query_id", "entity_id").distinct()
    few = evaluate.metrics_by_group(ranked, asked, members, group="label")
    assert sorted(few.collect()) == sorted(evaluate.metrics(ranked, gold).collect()) and few.count() == 7
