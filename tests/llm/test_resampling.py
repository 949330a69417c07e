"""Importance resampling against a plain version over all documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from fragmill.llm import resampling
from fragmill.llm.resampling import buckets_of, ranked, resample, up_to_kth

DOCS = "doc_id long, text string, rank string, n_words int, row string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None, longest: int) -> tuple[list[int], int]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [crc32(r.encode()) for r in runs], len(words)


def plain(docs: list, target: list, longest: int, buckets: int, least: int, percent: int) -> list:
    s, t = (Counter(f % buckets for text in texts for f in features(text, longest)[0]) for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in docs:
        found, n_words = features(text, longest)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark: SparkSession, longest: int) -> None:
    rng = np.random.default_rng(longest)
    vocabulary = [f"{a}{b}" for a in ("re", "Über", "x9", "日本", "ÉÀ") for b in ("tion", "", "Ing", "-y", "_z")]
    docs: list = [(int(k), " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))), "r", 3, "z") for k in rng.permutation(300) - 150]
    docs += [(1000, None, "", 0, ""), (1001, "", "", 0, ""), (1002, "!!! --- \x00", "", 0, ""), (None, "Tion " * 30, "", 0, ""), (7, "word " * 50_000, "", 0, "")]
    docs += [(2000, "Übertion " * 25, "", 0, "")] * 40  # a document that comes often
    target = ["Übertion x9Ing 日本 " * 9, None, "", "ÉÀ_z"]
    table = spark.createDataFrame(docs, DOCS).repartition(4)
    wanted = spark.createDataFrame([(t, "r") for t in target], "text string, rank string")
    rows = resample(table, wanted, longest, buckets=500, percent=30).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, plain(docs, target, longest, 500, 20, 30)))


def test_empty_tables(spark: SparkSession) -> None:
    docs, none = spark.createDataFrame([(k, "a b " * 20, "", 0, "") for k in range(20)], DOCS), spark.createDataFrame([], "text string")
    assert resample(docs.limit(0), none).count() == 0
    assert sorted(r["rank"] for r in resample(docs, none).where("rank is not null").collect()) == [1, 2]
    assert resample(docs.limit(9), none).where("rank is not null").count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(resampling, "PIECE", re.compile(rb".{1,7}[^ ]* *", re.DOTALL))
    text = "The  cat, sat\non THE mat é1 é1 é1 again-and again"
    for longest in (1, 2, 3, 5):
        found, n = features(text, longest)
        got, m = buckets_of(text.encode(), longest, 997)
        assert m == n and Counter(got.tolist()) == Counter(f % 997 for f in found)


@pytest.mark.parametrize("spread", [5, 70_000, 2**40, 2**63 - 1])
def test_radix_selection(spark: SparkSession, spread: int) -> None:
    """Every k, with ties in the first keys and values over the whole range of a long."""
    rng = np.random.default_rng(1)
    values = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.integers(-spread, spread, 200), rng.integers(-2, 3, 200), strict=True))]
    values += [(values[0][0], -1, 200 + k) for k in range(100)]
    rows, keys = spark.createDataFrame(values, "a long, b long, c long"), [F.col("a"), F.col("b"), F.col("c")]
    for k in (0, 1, 37, 150, 299, 300):
        taken = rows.where(up_to_kth(rows, keys, k))
        assert sorted(map(tuple, taken.collect())) == sorted(values)[:k]
    places = {(r["a"], r["b"], r["c"]): r["rank"] for r in ranked(rows, keys, rows_a_part=20).collect()}
    assert [places[v] for v in sorted(values)] == list(range(1, 301))
