"""The bag-of-words encoder works on each row by itself."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import SparkSession

from fragmill.operators.encode import HashingEncoder


def test_vectors_are_counts_of_each_row_without_a_shuffle(spark: SparkSession) -> None:
    texts = ["a b a", "", None, "Draw TWO cards draw", "1 2 3", "x " * 3000 + "y", "aa"]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "text_hash string, normalized string")
    encoded = HashingEncoder(8).encode(rows)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    found = {r["text_hash"]: r["vector"] for r in encoded.collect()}
    for k, t in enumerate(texts):
        n = Counter(zlib.crc32(w.encode()) % 8 for w in re.findall("[a-z]+", (t or "").lower()))
        norm = math.sqrt(sum(x * x for x in n.values())) or 1.0
        assert all(abs(found[str(k)][s] - n[s] / norm) < 1e-6 for s in range(8)) and len(found[str(k)]) == 8
