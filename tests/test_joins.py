"""Tables that grow with the corpus aren't sent through the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fragmill.operators.index import with_idf
from fragmill.operators.names import NameIndex


def test_corpus_tables_meet_by_merge_joins(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(f"t{k % 9}", f"n{k}", k) for k in range(90)], "text_hash string, name string, entity_id int")
    index = NameIndex.of(rows, ["entity_id"])
    for made, n in ((with_idf(rows, "text_hash"), 90), (index.candidates(rows, "n1"), 11)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert made.count() == n
