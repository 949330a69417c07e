"""Packing, token files and byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from fragmill.llm import packing
from fragmill.llm.bpe import bpe_encoder, encode_and_decode
from fragmill.llm.queries import tokenizer_path
from fragmill.llm.token_file import digest_token_files, read_token_files, write_token_files
from fragmill.llm.token_memo import byte_level_library, word_library

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = ["The first text, with marks... and 12 numbers.", None, "", "  two  spaces \n\n lines\t", "same", "same", "Ünïcode ß İ 한국어 🙂 <|endoftext|> it's", "x" * 5000, "word " * 3000, "a b́c\x1cd \x01e"]
SCHEMA = "doc_id long, text string, ids string, part string"


def ids_of(path: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark: SparkSession) -> DataFrame:
    """Texts with clashing column names, a null id and a repeated row."""
    rows = [(k, t, "x", "y") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", None, None), rows[4]], SCHEMA)


ALPHABET = st.text(st.sampled_from(" \n\t\r'\x1c\x01 aAbsStréÉßİ12½<|endoftext|>*.,!한²🙂"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_encoders_equal_the_library(text: str) -> None:
    for path, encoder in ((BYTE, byte_level_library(BYTE)), (WORD, word_library(WORD)), (BYTE, bpe_encoder(BYTE)[1])):
        assert encoder.encode([text])[0] == np.array(ids_of(path, text), dtype="<u4").tobytes()


def test_segment_tree_on_long_words_and_any_ids() -> None:
    bpe, encoder = bpe_encoder(BYTE)
    rng = random.Random(3)
    for word in ("a" * 3000, "ab" * 700, "".join(rng.choice("etaoinshr") for _ in range(2500))):
        assert encoder.encode([word])[0] == np.array(ids_of(BYTE, word), dtype="<u4").tobytes()
    ids = [rng.randrange(50257) for _ in range(2000)]
    assert bpe.decode(np.array(ids, dtype="<u4").tobytes()) == Tokenizer.from_file(BYTE).decode(ids, skip_special_tokens=False)


def test_bpe_query(docs: DataFrame) -> None:
    rows = encode_and_decode(docs, BYTE, keep_ids=True).collect()
    assert len(rows) == docs.count()
    library = Tokenizer.from_file(BYTE)
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = ids_of(BYTE, text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert encode_and_decode(docs.limit(0), BYTE).count() == 0


def test_token_files(docs: DataFrame, spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    write_token_files(docs, str(tmp_path / "t"), WORD, end_id=2, rows_per_file=3)
    rows = digest_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(((-1 if d["doc_id"] is None else d["doc_id"], d["text"] or "") for d in docs.collect()))
    start = 0
    for r, (doc, text) in zip(rows, order, strict=True):
        ids = [*ids_of(WORD, text), 2]
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), crc(ids))
        start += len(ids)
    plan = read_token_files(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "ids:array" not in plan.split("ReadSchema")[1].split("\n")[0]
    import pyarrow.parquet as pq

    file = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet")))
    ids = next(file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns) if file.metadata.row_group(0).column(i).path_in_schema.startswith("ids"))
    assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_offset_index
    # one doc_id on very many rows is cut into several files, too
    one = spark.range(300).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    write_token_files(one, str(tmp_path / "o"), WORD, end_id=2, rows_per_file=50)
    rows = digest_token_files(spark, str(tmp_path / "o")).orderBy("start").collect()
    assert len(rows) == 300 and [r["start"] for r in rows] == list(np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]))
    assert Counter(r["ids_crc32"] for r in rows) == Counter(crc([*ids_of(WORD, f"text {k}"), 2]) for k in range(300))
    assert max(r["count"] for r in read_token_files(spark, str(tmp_path / "o")).groupBy("part").count().collect()) < 150
    write_token_files(docs.limit(0), str(tmp_path / "e"), WORD, end_id=2)
    assert digest_token_files(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("max_broadcast_bytes", [64_000_000, 0])
def test_packing(docs: DataFrame, max_broadcast_bytes: int) -> None:
    rows = packing.pack(docs, BYTE, end_id=2, capacity=64, group_rows=5, max_broadcast_bytes=max_broadcast_bytes).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, own in pieces.items():
        text = "no id" if doc is None else TEXTS[doc]
        ids = [*ids_of(BYTE, text), 2]
        times = 2 if doc == 4 else 1
        assert len(own) == times * -(-len(ids) // 64)
        for r in own:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            assert r["length"] == 64 or r["piece"] == 0
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(docs.limit(0), BYTE, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_whole_and_tight(lengths: list[int]) -> None:
    counts = np.bincount(lengths, minlength=31) if lengths else np.zeros(31, dtype=np.int64)
    runs = packing.plan_runs(counts, 30)
    first = packing.best_fit(counts, 30)
    n = sum(b[0] for b in first)
    bins = packing.local_search(first, 30, packing.lower_bound(counts, 30))
    assert packing.lower_bound(counts, 30) <= sum(b[0] for b in bins) <= n
    held = Counter()
    for k, b, free in bins:
        assert sum(x * y for x, y in b.items()) + free == 30
        for x, y in b.items():
            held[x] += k * y
    assert held == Counter(lengths) and len({r[0] for r in runs}) == len(held)


def test_local_search_empties_bins() -> None:
    """Best fit leaves three bins here; exchanging one for one and two for one gives two full ones."""
    bins = [[1, {6: 1, 3: 1}, 1], [1, {5: 1, 3: 1}, 2], [1, {2: 1, 1: 1}, 7]]
    out = packing.local_search(bins, 10, 2)
    assert sum(b[0] for b in out) == 2


def test_local_search_goes_on_after_many_equal_bins() -> None:
    """No step helps the many emptiest bins; the next one can be emptied into those that lack 24 tokens."""
    bins = [[300_000, {350: 2}, 324], [1, {20: 36}, 304], [36, {1000: 1}, 24]]
    out = packing.local_search(bins, 1024, 0)
    held = Counter()
    for n, b, free in out:
        assert sum(x * y for x, y in b.items()) + free == 1024
        held.update({x: n * y for x, y in b.items()})
    assert held == {350: 600_000, 20: 36, 1000: 36} and sum(b[0] for b in out) == 300_036


def fewest_bins(lengths: tuple[int, ...], capacity: int) -> int:
    """The optimum, by trying every place of every piece."""
    best = len(lengths)

    def place(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for free in set(bins):
            if free >= lengths[k]:
                at = bins.index(free)
                place(k + 1, [*bins[:at], free - lengths[k], *bins[at + 1 :]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best


def test_small_packings_against_the_optimum() -> None:
    rng, over = random.Random(2), 0
    for _ in range(150):
        lengths = tuple(sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 10))), reverse=True))
        counts = np.bincount(lengths, minlength=21)
        bins = packing.local_search(packing.best_fit(counts, 20), 20, packing.lower_bound(counts, 20))
        n, least = sum(b[0] for b in bins), fewest_bins(lengths, 20)
        assert packing.lower_bound(counts, 20) <= least <= n <= least + 1
        over += n > least
    assert over <= 5


@pytest.fixture(scope="module")
def real_lengths() -> np.ndarray:
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    return np.array([len(x) // 4 + 1 for x in byte_level_library(BYTE).encode([t or "" for t in texts])])


def test_local_search_empties_bins_of_real_lengths(real_lengths: np.ndarray) -> None:
    counts = np.bincount(real_lengths[(real_lengths >= 250) & (real_lengths <= 520)], minlength=1025)
    first = packing.best_fit(counts, 1024)
    found = packing.local_search(first, 1024, packing.lower_bound(counts, 1024))
    assert sum(b[0] for b in found) <= 0.97 * sum(b[0] for b in first)


@pytest.mark.parametrize("kind", ["uniform", "log-normal"])
def test_the_search_takes_as_many_steps_for_any_corpus(kind: str) -> None:
    """Of 20,000 and 20 billion pieces of the same proportions, with counts that no number divides."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(250, 520, 20_000) if kind == "uniform" else np.clip(rng.lognormal(5.5, 1.0, 20_000).astype(int), 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    steps, shares = [], []
    for times in (1, 1000, 1_000_000):
        many = counts * times + rng.integers(0, times, 1025) * (counts > 0)
        first, taken = packing.best_fit(many, 1024), []
        found = packing.scaled_search(first, 1024, packing.lower_bound(many, 1024), taken)
        held = np.zeros(1025, dtype=np.int64)
        for n, b, free in found:
            assert n > 0 and sum(x * y for x, y in b.items()) + free == 1024
            for x, y in b.items():
                held[x] += n * y
        assert held.tolist() == many.tolist()
        before, after = (sum(b[0] for b in bins) for bins in (first, found))
        assert packing.lower_bound(many, 1024) <= after <= before
        steps.append(sum(taken))
        shares.append(after / before)
    assert max(steps[1:]) <= 2 * steps[0] + 2_000 and max(shares) <= min(shares) + 0.01


def test_the_plan_does_not_grow_with_the_corpus(real_lengths: np.ndarray) -> None:
    counts = np.bincount(real_lengths % 1024, minlength=1025)
    counts[0] = 0
    rows = [len(packing.plan_runs(counts * times, 1024)) for times in (1, 1000)]
    assert rows[1] <= 1.5 * rows[0] and rows[1] < 10_000
    one = np.zeros(1025, dtype=np.int64)
    one[342] = 1_000_000
    assert len(packing.plan_runs(one, 1024)) <= 4


def test_no_sequence_of_a_large_corpus_is_left_unsearched() -> None:
    """The plan of 2 million pieces, as that of 2,000: a second search finds no step between any two sequences."""
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.integers(250, 520, 2000), minlength=1025)
    for times in (1, 1000):
        many = counts * times + rng.integers(0, times, 1025) * (counts > 0)
        runs = packing.plan_runs(many, 1024).tolist()
        held: dict[int, dict[int, int]] = {}
        for length, _, sequence, each, _ in runs:
            held.setdefault(sequence, {})[length] = each
        starts = sorted(held)
        length, rank, _, each, _ = max((r for r in runs if r[2] == starts[-1]), key=lambda r: r[1])
        ends = [*starts[1:], starts[-1] + (int(many[length]) - rank) // each]
        bins = [[b - a, held[a], 1024 - sum(x * y for x, y in held[a].items())] for a, b in zip(starts, ends, strict=True)]
        assert sum(n * x * y for n, h, _ in bins for x, y in h.items()) == (many * np.arange(1025)).sum()
        taken: list[int] = []
        packing.local_search(bins, 1024, packing.lower_bound(many, 1024), taken)
        assert taken == [0]
