"""Removal of repeated strings, against a plain search of all strings of every document."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import SparkSession

from fragmill.llm import suffix_sort
from fragmill.llm.substring_dedup import SLICE, dedup_substrings, find_runs
from fragmill.llm.suffix_sort import sort_suffixes

SCHEMA = "doc_id long, text string, row string, block int, kept string"


def plain(docs: list, length: int) -> list:
    texts = [(d[0], (d[1] or "").encode()) for d in docs]
    order = lambda i: (i is None, i or 0)
    first: dict[bytes, tuple] = {}
    for doc_id, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, order(doc_id)), order(doc_id))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < order(doc_id):
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), sum(len(x) > 0 for x in bytes(gone).split(b"\0")), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed: int) -> list:
    """Copies, near copies, shared passages, texts that repeat themselves, and odd rows."""
    rng = np.random.default_rng(seed)
    words = ["the", "Ütöl", "a", "日本", "zebra", "of", "\n", "  ", "in", "xyz"]
    text = lambda n: " ".join(rng.choice(words, n))
    passages, docs = [text(25) for _ in range(6)], []
    for _ in range(60):
        parts = [text(int(rng.integers(0, 40))) for _ in range(3)]
        docs.append(parts[0] + str(rng.choice(passages)) + parts[1] + str(rng.choice(passages)) + parts[2])
    for k in range(30):
        t = list(docs[k % 5])
        for at in rng.integers(0, len(t), 3):
            t[at] = "#"
        docs.append("".join(t))
    docs += docs[:10] + ["a" * 400, "b" + "a" * 300 + "c", "ab" * 200, "x" * 49, "x" * 50, "x" * 51, "", passages[0]]
    rows: list = [(int(i), t, "r", 1, "k") for i, t in zip(rng.permutation(len(docs)) - 20, docs, strict=True)]
    rows += [(500, None, "", 0, ""), (None, docs[0], "", 0, ""), (None, docs[1], "", 0, ""), (rows[3][0], docs[7], "", 0, ""), (rows[5][0], rows[5][1], "", 0, "")]
    return rows


@pytest.mark.parametrize(("length", "most_pieces", "block_bytes"), [(50, 20_000, 4_000_000), (50, 2, 3_000), (12, 3, 1_000), (90, 20_000, 2_000)])
def test_equals_a_plain_search(spark: SparkSession, length: int, most_pieces: int, block_bytes: int) -> None:
    docs = corpus(length)
    table = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = dedup_substrings(table, length, keep_text=True, block_bytes=block_bytes, most_pieces=most_pieces).collect()
    got = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"]))) for r in rows)
    expected = plain(docs, length)
    assert got == sorted(map(str, expected))
    assert sum(e[2] for e in expected) > 1000


def test_empty_tables_and_texts(spark: SparkSession) -> None:
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).collect() == [] and dedup_substrings(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    none = dedup_substrings(spark.createDataFrame([(1, None, "", 0, ""), (2, "", "", 0, ""), (3, "short", "", 0, "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in none) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0)]


def test_texts_longer_than_a_slice(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    long = "".join(chr(c) for c in rng.integers(97, 123, 2 * SLICE + 7_000))
    docs = [(2, long[:SLICE] + "!" + long[SLICE:], "", 0, ""), (1, long, "", 0, ""), (3, long[SLICE - 200 : SLICE + 200] + "?" + "z" * 300, "", 0, "")]
    rows = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in dedup_substrings(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert rows == {1: (0, 0), 2: (len(long), 2), 3: (400, 1)}


def test_runs_cover_every_string_once() -> None:
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 3 * SLICE, dtype=np.uint8)
    data[1000:3000] = 97
    starts = np.array([0, 10, 10, 70, 500, SLICE + 3, len(data) - 20])
    at, count, place = find_runs(data, starts, 50)
    ends = np.append(starts[1:], len(data))
    expected = np.concatenate([np.arange(a, max(a, b - 49)) for a, b in zip(starts, ends, strict=True)])
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(at, count, strict=True)]).tolist() == expected.tolist()
    assert count.max() <= 27 and (place < 27).all()
    for k in rng.integers(0, len(at), 2000):
        anchor = data[at[k] + place[k] : at[k] + place[k] + 24].tobytes()
        assert all(anchor in data[at[k] + j : at[k] + j + 50].tobytes() for j in range(count[k]))


def suffixes_of(texts: list[bytes], groups: list[int], length: int) -> tuple:
    counts = [len(t) - length + 1 for t in texts]
    owner, offset = np.repeat(np.arange(len(texts)), counts), np.concatenate([np.arange(n) for n in counts])
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts, owner, offset, np.array(groups, dtype=np.uint64)[owner], length


@pytest.mark.parametrize("length", [1, 7, 8, 20])
def test_suffix_sort(length: int) -> None:
    rng = np.random.default_rng(length)
    for _ in range(30):
        texts = [bytes(rng.integers(0, 2, int(rng.integers(length, 60)), dtype=np.uint8) * 255) for _ in range(int(rng.integers(1, 9)))]
        groups = rng.integers(0, 3, len(texts)).tolist()
        data, starts, owner, offset, group, _ = suffixes_of(texts, groups, length)
        order, same = sort_suffixes(data, starts, owner, offset, group, length)
        keys = [(int(group[k]), texts[owner[k]][offset[k] : offset[k] + length]) for k in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(owner)))
        assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_collisions_are_found_and_sorted_again(monkeypatch: pytest.MonkeyPatch) -> None:
    """With a hash under which all texts of a length are equal, the bytes of neighbours show it."""
    texts = [b"abcdefghijkl", b"abcdefghijzz", b"abcdefghijka"]
    tried, sound = [], suffix_sort.hash_numbers

    def weak(seed: int) -> tuple[np.ndarray, int]:
        tried.append(seed)
        return (np.ones(256, dtype=np.uint64), 1) if seed == 0 else sound(seed)

    monkeypatch.setattr(suffix_sort, "hash_numbers", weak)
    order, same = sort_suffixes(*suffixes_of(texts, [0, 0, 0], 12))
    assert order.tolist() == [2, 0, 1] and not same.any() and tried == [0, 1]
