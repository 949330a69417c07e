"""Similarity join, line dedup, language identification, pages and the pipeline, against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from fragmill.llm import block_pairs, chosen_path, html_text, language_id, line_dedup, url_trie
from fragmill.llm.html_labels import labelled_pages
from fragmill.llm.html_text import extract, main_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(600)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


def classes_of(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Links and smallest member of each text's class, pair by pair."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    shared = prose(60)
    out: list[str | None] = [None, "", "   ", "one", "One", "two words", prose(20_000)]
    for _ in range(25):
        base = prose(RNG.randint(30, 200))
        out += [base, base, edited(base, 1), edited(base, 2), edited(base, 12), f"{prose(100)} {shared} {prose(100)}"]
    base = prose(150)
    out += [edited(base, 1) for _ in range(60)] + [base.upper()] * 20
    return out


def test_similarity_join(spark: SparkSession, texts: list[str | None]) -> None:
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_links int, class_id string")
    rows = {r["doc_id"]: r for r in chosen_path.similarity_join(docs, brute_force=8, block_sets=8).collect()}
    links, root = classes_of(texts)
    assert [rows[k]["n_links"] for k in range(len(texts))] == links
    assert [rows[k]["class_id"] for k in range(len(texts))] == root
    assert [rows[k]["kept"] for k in range(len(texts))] == [r == k for k, r in enumerate(root)]


def test_similarity_join_edges(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (2, "other"), (None, None)], "doc_id long, text string")
    rows = chosen_path.similarity_join(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"], r["class_id"] or -1) for r in rows) == [(-1, 0, -1), (-1, 2, 5), (2, 0, 2), (5, 2, 5), (5, 2, 5)]
    assert sorted(r["text"] or "" for r in chosen_path.keep_one_of_each(docs).collect()) == ["", "a b c", "other"]
    assert chosen_path.similarity_join(docs.limit(0)).count() == 0


def test_recall_at_the_deepest_level(spark: SparkSession) -> None:
    """Pairs at the threshold whose nodes are split down to the last level; seven runs found about 95 of 100."""
    rng, n = np.random.default_rng(5), 1500
    left = rng.integers(0, 2**32, (n, chosen_path.PLACES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 2**32, left.shape, dtype=np.uint32))
    rows = [(f"{k}{side}".encode(), t.tobytes()) for side, ts in (("a", left), ("b", right)) for k, t in enumerate(ts)]
    edges = chosen_path.candidate_edges(spark.createDataFrame(rows, "set binary, tokens binary"), 0.8, 0.999, brute_force=1).distinct().collect()
    assert all(bytes(r["a"])[:-1] == bytes(r["b"])[:-1] for r in edges) and len(edges) >= 0.996 * n


def test_pairs_that_agree_in_few_places_are_candidates(spark: SparkSession) -> None:
    """36 of 64 places is rare for a pair at 0.8, and the same in every run."""
    left = np.arange(chosen_path.PLACES, dtype=np.uint32)
    rows = [(1, b"a", left.tobytes()), (1, b"b", np.where(left < 36, left, left + 1000).astype(np.uint32).tobytes())]
    members = spark.createDataFrame(rows, "node long, set binary, tokens binary")
    assert [(bytes(r["a"]), bytes(r["b"])) for r in chosen_path._compare_small(members, 0.8).collect()] == [(b"a", b"b")]


def test_blocks_cover_all_pairs() -> None:
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(n)] for n in (9, 4))
    found = chosen_path.similar(left, right, 0.5)
    assert all(found[i, j] == (len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))) for i, a in enumerate(left) for j, b in enumerate(right))
    rows = [(k % 2, bytes([k]), 1 + k % 3, s) for k, s in enumerate([*left, *right])]
    linked = {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and chosen_path.similar([a[3]], [b[3]], 0.4)[0, 0]}
    for group in ((b"c", 0, 0), (b"c", 0, 1), (b"c", 1, 1)):
        pairs = {(a[1], b[1]) for a in rows for b in rows if (a[1], b[1]) in linked and sorted((a[0], b[0])) == list(group[1:])}
        for tile in (2, 3, 512):
            out = block_pairs.compare_blocks(group, rows, lambda x, y: chosen_path.similar([r[3] for r in x], [r[3] for r in y], 0.4), tile)
            assert {a: n for a, n, b in out if b is None} == dict(Counter({a: sum(r[2] for r in rows if (a, r[1]) in pairs) for a, _ in pairs}))
            edges = [(a, b) for a, _, b in out if b is not None]
            assert set(edges) <= pairs and components_of(edges) == components_of(pairs)
            assert len(edges) == len({x for e in edges for x in e}) - len(components_of(edges))


def components_of(pairs) -> set[frozenset]:  # noqa: ANN001
    root: dict = {}
    for a, b in pairs:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        root = {k: x if r == y else r for k, r in root.items()}
    return {frozenset(k for k, r in root.items() if r == x) for x in set(root.values())}


def test_groups_of_near_copies_are_joined_whole(spark: SparkSession) -> None:
    """A large node of near copies is one group at once, one with other sets in it is split on."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, chosen_path.PLACES, dtype=np.uint32)
    copies = [np.where(rng.random(len(base)) < 0.9, base, rng.integers(0, 2**32, len(base), dtype=np.uint32)) for _ in range(60)]
    half = [np.where(np.arange(len(base)) < 20, base, rng.integers(0, 2**32, len(base), dtype=np.uint32)) for _ in range(60)]
    rows = [(f"{kind}{k:03}".encode(), t.tobytes()) for kind, ts in (("c", copies), ("h", half)) for k, t in enumerate(ts)]
    edges = chosen_path.candidate_edges(spark.createDataFrame(rows, "set binary, tokens binary"), 0.8, 0.999, brute_force=16).distinct().collect()
    groups = components_of([(bytes(r["a"]), bytes(r["b"])) for r in edges])
    assert groups == {frozenset(f"c{k:03}".encode() for k in range(60))}


def plain_line_dedup(docs: list[tuple[int, str]], min_words: int, moved_words: int, all_pairs: bool = False) -> dict[int, list[str]]:
    """Documents aligned with plain code: all that overlap, or each with the first holder of every line and run of it; what crosses an
    alignment is aligned again, run by run."""
    split = {doc: [x.strip() for x in text.split("\n") if x.strip()] for doc, text in docs}
    lines = {doc: [(x, own[:k].count(x)) for k, x in enumerate(own)] for doc, own in split.items()}
    held_by = Counter(t for own in lines.values() for t in own)
    size = lambda xs: sum(len(x.split()) for x in xs)

    def finders(doc: int) -> set:
        own = split[doc]
        found = {t for t in lines[doc] if size([t[0]]) >= min_words}
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                run = own[i:j]
                # the shortest runs with enough words around one of their short lines
                if size(run) >= min_words and any(size([x]) < min_words and (k == 0 or size(run[1:]) < min_words) and (k == len(run) - 1 or size(run[:-1]) < min_words) for k, x in enumerate(run)):
                    found.add(tuple(run))
        shared = [t for t in lines[doc] if held_by[t] > 1]
        for n in (2, 4, 8, 16):
            found |= {("run", *run) for run in zip(*(shared[i:] for i in range(n)), strict=False) if size(x for x, _ in run) >= min_words}
        return found

    tokens = {doc: finders(doc) for doc in split}
    holders: dict = {}
    for doc in sorted(tokens):
        for t in tokens[doc]:
            holders.setdefault(t, []).append(doc)

    def runs(pairs: set) -> list[list[tuple[int, int]]]:
        out = []
        for a, b in sorted(pairs):
            if (a - 1, b - 1) not in pairs:
                n = next(n for n in range(1, len(pairs) + 1) if (a + n, b + n) not in pairs)
                out.append([(a + i, b + i) for i in range(n)])
        return out

    out = {}
    for later in sorted(split):
        gone: set[int] = set()
        words = lambda places: size(split[later][a] for a in places)  # noqa: B023, E731
        for earlier in sorted(split):
            if earlier >= later or not any(t in tokens[earlier] and (all_pairs or holders[t][0] == earlier) for t in tokens[later]):
                continue
            place = {t: k for k, t in enumerate(lines[earlier])}
            matches = [(k, place[t]) for k, t in enumerate(lines[later]) if t in place]
            once = [(a, b) for a, b in matches if split[later].count(split[later][a]) == 1 == split[earlier].count(split[earlier][b])]
            aligned = list(line_dedup.longest_rise(once))
            bounds = [(-1, -1), *aligned, (10**9, 10**9)]
            for (a0, b0), (a1, b1) in zip(bounds, bounds[1:], strict=False):
                aligned += line_dedup.longest_rise([(a, b) for a, b in matches if (a, b) not in once and a0 < a < a1 and b0 < b < b1])
            gone |= {a for run in runs(set(aligned)) if words(a for a, _ in run) >= min_words for a, _ in run}
            left = runs(set(matches) - set(aligned))
            while left:  # aligned again, whole runs at a time
                starts = set(line_dedup.longest_rise([run[0] for run in left]))
                gone |= {a for run in left if run[0] in starts and words(a for a, _ in run) >= moved_words for a, _ in run}
                left = [run for run in left if run[0] not in starts]
        own = split[later]
        again = runs({(k, min(a for a in gone if own[a] == x)) for k, x in enumerate(own) if k not in gone and x in {own[a] for a in gone}})
        gone |= {a for run in again if words(a for a, _ in run) >= moved_words for a, _ in run}
        out[later] = [x for k, x in enumerate(own) if k not in gone]
    return out


def test_line_dedup_equals_plain_pairs(spark: SparkSession) -> None:
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 6, 14)))) for _ in range(60)]
    docs = []
    for k in range(150):
        own: list[str] = []
        for _ in range(rng.randint(1, 5)):
            if docs and rng.random() < 0.7:  # a stretch of an earlier document, its parts sometimes in another order
                lines = rng.choice(docs)[1].split("\n")
                at = rng.randrange(len(lines))
                parts = [lines[at : at + 2], lines[at + 2 : at + 5]]
                rng.shuffle(parts)
                own += [x for p in parts for x in p]
            else:
                own.append(rng.choice(pool) if rng.random() < 0.6 else prose(rng.choice((2, 6, 15))))
        docs.append((k, "\n".join(own[:14])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()}
    expected = plain_line_dedup(docs, 4, 12)
    assert {k: [x for x in t.split("\n") if x] for k, t in rows.items()} == expected
    assert sum(map(len, expected.values())) < sum(len(t.split("\n")) for _, t in docs)
    # what the alignment of all overlapping documents takes away: all of it where a line alone is a moved block
    for doc, left in plain_line_dedup(docs, 4, 12, all_pairs=True).items():
        assert not Counter(left) - Counter(expected[doc])
        assert [x for x in left if len(x.split()) >= 12] == [x for x in expected[doc] if len(x.split()) >= 12]


def test_lines_of_many_holders_equal_all_pairs(spark: SparkSession) -> None:
    """Lines, couples and passages that six and more documents hold, each document with others of them, in their order."""
    rng = random.Random(8)
    passages = [[prose(rng.choice((2, 5, 7))) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    docs = []
    for k in range(120):
        own: list[str] = []
        for p in sorted(rng.sample(range(12), rng.randint(1, 4))):
            own += [prose(8), *passages[p]]
        docs.append((k, "\n".join(own)))
    held = Counter(x for _, t in docs for x in t.split("\n"))
    assert sum(n > 5 for n in held.values()) > 30
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: [x for x in t.split("\n") if x] for k, t in rows.items()} == plain_line_dedup(docs, 4, 12, all_pairs=True)


def test_two_documents_meet_by_a_run_of_frequent_lines(spark: SparkSession) -> None:
    """Short sentences that cross the alignment with their first holder, but not that with the document that has them in a row."""
    a, b = "five words are in here", "and some more stand there"
    docs = [(1, f"{b}\nfirst of all\n{a}"), *((k, f"own text {k}\n{b}") for k in range(2, 9)), (9, f"{a}\n{b}\nnine"), *((k, f"{a}\nwhat is new in {k}\n{b}") for k in range(10, 13))]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {rows[k] for k in range(10, 13)} == {f"what is new in {k}" for k in range(10, 13)}


def test_runs_of_doubled_length() -> None:
    tokens = [bytes([k]) for k in range(9)]
    runs = [list(line_dedup.ladder(tokens[:n], [2] * n, 4)) for n in range(10)]
    assert [len(x) for x in runs] == [0, 0, 1, 2, 4, 6, 8, 10, 13, 16] and len(set(runs[9])) == 16
    assert list(line_dedup.ladder(tokens[:4], [1] * 4, 4)) == runs[4][3:]  # only the whole has four words


def test_the_alignment_decides(spark: SparkSession) -> None:
    """Lines that cross the alignment stay if they are short, and go as a moved block if they are long."""
    a, b, c, d = "one line of five words", "another line of six words here", "the third of these lines is here", "and this is the fourth of them all"
    long = [prose(9), prose(9)]
    e, f = "eight short words stand here in a row", "twelve words stand in this line and it is one row more"
    rows = [(1, "\n".join([a, b, c, *long, d])), (2, "\n".join([b, c, d, a])), (4, "\n".join([e, f, *long])), (5, "\n".join([*long, "new", e])), (6, "\n".join([*long, "newer", f]))]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == a  # all but the line that stands out of order
    assert out[5] == f"new\n{e}" and out[6] == "newer"  # eight words that cross are too few to be a moved block
    assert line_dedup.deleted_places([(0, 6, True, 9), (1, 7, True, 9), (2, 0, True, 9), (3, 1, True, 9), (4, 2, True, 9)], 4, 12) == set(range(5))
    assert line_dedup.deleted_places([(0, 6, True, 9), (2, 0, True, 9), (3, 1, True, 9), (4, 2, True, 9)], 4, 12) == {2, 3, 4}


def test_line_dedup(spark: SparkSession) -> None:
    """A line that many documents hold goes from all but the first; a shared line goes with its pair."""
    common, hot = [prose(12) for _ in range(5)], prose(6)
    docs = []
    for k in range(40):
        own = [prose(10) for _ in range(4)]
        docs.append((k, "\n".join([own[0], *([common[k % 5]] if k % 3 else []), own[1], hot, own[2], "a b", own[3]])))
    docs.append((40, docs[3][1]))
    table = spark.createDataFrame([(k, t, 9) for k, t in docs], "doc_id long, text string, n_lines int")
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(table).collect()}
    assert {k: [x for x in r["text"].split("\n") if x] for k, r in rows.items()} == plain_line_dedup(docs, 4, 12)
    assert rows[40]["text"] == "" and rows[40]["n_deleted"] == rows[40]["n_lines"]


def test_line_dedup_edges(spark: SparkSession) -> None:
    long = "\n".join(f"line number {k} of a long text" for k in range(3000))
    rows = [(1, "a b c d e\nown line of one here"), (1, "a b c d e\nown line of one here"), (None, "a b c d e"), (2, None), (3, ""), (4, "x y z w\nx y z w\n\nq"), (5, long), (6, long + "\nnew words at the end")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"] or -1, r["text"], r["n_deleted"]) for r in out), key=str)
    assert (-1, "", 1) in found and (2, None, 0) in found and (3, "", 0) in found and (4, "x y z w\nx y z w\n\nq", 0) in found
    assert found.count((1, "a b c d e\nown line of one here", 0)) == 2
    assert (6, "new words at the end", 3000) in found and (5, long, 0) in found
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_around_short_lines() -> None:
    rng = random.Random(4)
    for _ in range(300):
        counts = [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]
        for at, n in enumerate(counts):
            if n < 4:
                enough = [(i, j) for i in range(at + 1) for j in range(at, len(counts)) if sum(counts[i : j + 1]) >= 4]
                shortest = {(i, j) for i, j in enough if not any((x, y) != (i, j) and i <= x and y <= j for x, y in enough)}
                assert set(line_dedup.runs_around(counts, at, 4)) == shortest


def test_alignment() -> None:
    assert line_dedup.longest_rise([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert line_dedup.align([(0, 0, True), (1, 1, False), (2, 5, True), (3, 2, False)]) == [(0, 0), (1, 1), (2, 5)]
    assert line_dedup.deleted_places([(0, 0, True, 3), (2, 5, True, 9)], 4, 12) == {2}
    assert line_dedup.deleted_places([(0, 0, True, 2), (1, 1, True, 2)], 4, 12) == {0, 1}


def test_held_out(spark: SparkSession) -> None:
    rows = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


@pytest.fixture(scope="module")
def labelled(spark: SparkSession) -> DataFrame:
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language(spark: SparkSession, labelled: DataFrame) -> None:
    odd = spark.createDataFrame([(None, None, None, None, 0), (900001, "12 34 !", "en", "s", 0), (900002, "", None, None, 0), (900003, "Le chat " * 20000, None, "s", 0)], SCHEMA)
    docs = labelled.unionByName(odd).withColumn("lang_pred", F.lit("clash"))
    found = language_id.identify(docs).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (None, 900001, 900002))
    held = [r for r in found if r["held"] and r["lang"] and r["doc_id"] < 900000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_gradients_equal_differences() -> None:
    net, rng = language_id.ByteCnn(["a", "b", "c"]), np.random.default_rng(2)
    net.embedding, net.dense, net.bias = (w.astype(np.float64) for w in (net.embedding, net.dense, net.bias))
    net.banks = [b.astype(np.float64) for b in net.banks]
    x, y = rng.integers(0, 256, (4, language_id.WINDOW)), np.array([0, 1, 2, 1])
    grads = net.gradients(x, y)[1]
    for weight, grad in zip(net.weights(), grads, strict=True):
        for at in rng.permutation(np.flatnonzero(np.abs(grad) > 1e-4))[:5]:
            before = weight.flat[at]
            losses = []
            for step in (1e-6, -1e-6):
                weight.flat[at] = before + step
                losses.append(net.gradients(x, y)[0])
            weight.flat[at] = before
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(grad.flat[at], rel=1e-3, abs=1e-7)


def test_whole_texts_equal_plain_prediction(spark: SparkSession) -> None:
    """Every window of a text takes part, by its bytes; sums over bytes instead of tables."""
    net = language_id.ByteCnn(["a", "b", "c"])
    texts = ["short words", "é" * 300 + " and more", prose(300)]
    rows = language_id.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), net).collect()
    for r in rows:
        data, total = texts[r["doc_id"]].encode(), np.zeros(3)
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            window = net.embedding[np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), dtype=np.uint8)]
            pooled = [max(sum(window[i + j] @ bank[j][:, f] for j in range(w)) for i in range(language_id.WINDOW - w + 1)) for w, bank in zip(language_id.WIDTHS, net.banks, strict=True) for f in range(language_id.FILTERS)]
            e = np.exp(np.maximum(pooled, 0) @ net.dense + net.bias)
            total += len(part) * e / e.sum()
        assert r["lang_pred"] == net.labels[int(total.argmax())] and r["score"] == pytest.approx(total.max() / len(data), abs=1e-4)


def test_tables_equal_the_filters() -> None:
    """A window's response by tables equals the sum over its bytes."""
    net = language_id.ByteCnn(["a", "b"])
    x = np.frombuffer(random.Random(1).randbytes(2 * language_id.WINDOW), dtype=np.uint8).reshape(2, -1)
    pooled = []
    for w, bank in zip(language_id.WIDTHS, net.banks, strict=True):
        n = language_id.WINDOW - w + 1
        pooled.append(sum((net.embedding @ bank[j])[x[:, j : j + n]] for j in range(w)).max(1))
    expected = language_id._softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net.dense + net.bias)
    assert np.allclose(net.probabilities(x, net.tables()), expected, atol=1e-4)


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="with-sidebar"><nav><a href="/">Home</a></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>The &amp; title</h1><p>First
 part <b>bold</b>&nbsp;<a href="x">linked words</a>.<p>Second 3 &lt; 4.</p><div class="ad"><p>Buy now and save.</p></div><ul><li>One</li><li>Two</li></ul>
</article><section class="comments"><p>Nice text, I liked it.</p></section><aside>See also</aside><footer><p>Copyright</p></footer></body></html>"""


def test_html() -> None:
    assert main_text(PAGE) == "The & title\nFirst part bold linked words.\nSecond 3 < 4.\nOne\nTwo"
    assert main_text("") == "" and main_text("<nav><a href='/'>x</a></nav>") == "" and main_text("<p>cut <b") == "cut"
    assert main_text("<html><body>plain words here<br>and there</body></html>") == "plain words here\nand there"


def test_html_keeps_what_stands_in_other_elements() -> None:
    """No element but scripts and the like takes its content, or without an end tag the rest of the page, away."""
    options = "<datalist><option value=a><option value=b></datalist>"
    assert main_text(f"<body><article><p>Some words before.</p>{options}<p>The whole article follows here.</p></article></body>") == "Some words before.\nThe whole article follows here."
    for name in ("noscript", "object", "canvas", "math", "svg", "template"):
        assert main_text(f"<article><p>Words before <{name}>and within it</{name}> and after it.</p></article>").split() == "Words before and within it and after it.".split()


ARTICLE_TEXT = "".join(f"<p>Rivers carry silt down to the plain number {k} where farmers have worked the land for many years.</p>" for k in range(5))
ARTICLE_LINES = [f"Rivers carry silt down to the plain number {k} where farmers have worked the land for many years." for k in range(5)]
AROUND = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<div class='comments'><div class='comment'><p>I liked to read this a lot.</p></div></div><footer><p>Copyright of the authors</p></footer></body></html>"


@pytest.mark.parametrize("wrapper", [
    '<div id="page" class="has-ads"><article>{}</article></div>', '<div class="wrap with-comments">{}</div>', '<article><div class="legal-text">{}</div></article>', '<section id="popular-science">{}</section>',
    '<form id="aspnetForm">{}</form>', '<div><select><option></div>{}', '<article>{}<script>var x = "<p>no</p>"</article>', "<div><textarea></div>{}", "<div class='sidebar-layout'><div class='ad-free'><main>{}</main></div></div>",
])
def test_wrappers_do_not_take_the_article_away(wrapper: str) -> None:
    for page in (wrapper.format(ARTICLE_TEXT), AROUND.format(wrapper.format(ARTICLE_TEXT))):
        assert main_text(page).split("\n") == ARTICLE_LINES


def test_marked_parts_go_though_they_are_large() -> None:
    """Comments of more words than the article aren't a wrapper, and neither is a menu on a page without any other text."""
    said = "".join(f"<div class='comment'><p>This is what reader number {k} says about all of it, and at some length too.</p></div>" for k in range(12))
    assert main_text(f"<article>{ARTICLE_TEXT}</article><section class='comments'>{said}</section>").split("\n") == ARTICLE_LINES
    assert main_text(f"<div class='menu'>{'<a href=x>one entry</a> ' * 60}</div>") == ""


@pytest.mark.parametrize("name", ["popular-music", "share-prices", "follow-up", "alert-systems", "promotion-history", "legal-text", "dialog"])
def test_a_name_that_contains_a_mark_takes_nothing_away(name: str) -> None:
    assert main_text(f"<article>Alpha beta<div class='{name}'>Gamma delta</div>Epsilon zeta</article>") == "Alpha beta\nGamma delta\nEpsilon zeta"
    for plain in ("ad-slot", "comment-body", "site-footer", "cookie-notice"):
        assert main_text(f"<article><p>Alpha beta.</p><div class='{plain}'>Gamma delta</div><p>Epsilon zeta.</p></article>") == "Alpha beta.\nEpsilon zeta."


def test_short_pages_are_whole() -> None:
    said = "The bridge is closed until Monday morning."
    for page in ("{}", "<form id='f'>{}</form>", "<div class='with-sidebar'>{}</div>", "<!-->{}", "<!--->{}", "<body><form><p>{}</p><input><button>Go</button></form></body>", "<article><p>{}</p></article>"):
        assert main_text(page.format(said)) == said
    assert main_text("<article><h1>Two words</h1><p>One</p><p>Two here</p></article>") == "Two words\nOne\nTwo here"
    assert main_text("<nav><a href='/'>Home</a></nav><form>Search <input></form><div class='ad'>Buy now. It is cheap.</div><article></article><footer>Copyright</footer>") == ""


def test_formulas_stand_in_their_line_and_a_left_out_part_costs_once() -> None:
    assert main_text("<p>Let <math><mrow><mi>x</mi></mrow></math> be <svg><g><text>y</text></g></svg> a number.</p>") == "Let x be y a number."
    links = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(60))
    assert main_text(f"<article><p>First part of it.</p><nav><ul>{links}</ul></nav><p>Second part.</p></article>") == "First part of it.\nSecond part."


def test_the_scan_is_better_than_no_scan_on_pages_it_was_not_fitted_on() -> None:
    """By the words that are right: against all words that score above zero, and against all that aren't left out."""
    totals = [0.0, 0.0, 0.0]
    for page in labelled_pages(300, seed=77):
        wanted = Counter(w for part in re.findall(r"<!--content-->(.*?)<!--/content-->", page, re.S) for w in re.sub(r"<[^>]*>", " ", part).split())
        clean = html_text.CONTENT_MARKS.sub("", page)
        runs = [(score, left_out, x.text) for score, left_out, x in html_text.scored(clean) if isinstance(x, html_text.Run)]
        for k, words in enumerate((main_text(clean), " ".join(t for s, _, t in runs if s > 0), " ".join(t for _, out, t in runs if not out))):
            found = Counter(words.split())
            totals[k] += 2 * (found & wanted).total() / (found.total() + wanted.total())
    assert totals[0] > max(totals[1:]) and totals[0] / 300 > 0.94


def test_region_equals_all_intervals() -> None:
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        first, last = html_text.best_region(scores)
        assert sum(scores[first:last]) == max([0, *sums.values()])


def test_the_scan_decides_where_no_mark_does() -> None:
    """Stray sentences behind long lists of links score above zero word by word; the region leaves them out."""
    linked = "".join(f"<div><div><a href='/{k}'>x{k}</a></div></div>" for k in range(40))
    page = f"<html><body><p>Free edition.</p>{linked}<div>{ARTICLE_TEXT}</div>{linked}<p>Thank you and come back.</p></body></html>"
    assert main_text(page).split("\n") == ARTICLE_LINES
    parts = html_text.scored(page)
    assert any(score > 0 and isinstance(x, html_text.Run) and "Thank you" in x.text for score, _, x in parts)
    scores = [p[0] for p in parts]
    first, last = html_text.best_region(scores)
    assert sum(scores[first:last]) == pytest.approx(max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))


def test_html_table(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (3, "v", "<p>" + "long " * 50000, "x")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in extract(pages).collect()}
    assert rows[2]["text"] == "" and rows[2]["n_chars"] == 0 and rows[3]["n_chars"] == 249999 and rows[1]["n_chars"] == len(rows[1]["text"])
    assert extract(pages.limit(0)).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es"), ("allow", "net", "/es"), ("block", "", "/x")]


def test_urls(spark: SparkSession) -> None:
    urls = {
        "http://a.Example.COM/en/1?q": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"), "http://b.net/estate": ("b.net", "/estate", "net/es", "block"), "http://b.net": ("b.net", "", None, "allow"),
        "http://q.org/x/y#z": ("q.org", "/x/y", "/x", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://example.com?en/": ("example.com", "", None, "allow"),
        "http://" + "a." * 500 + "com/" + "s/" * 500: ("a." * 500 + "com", "/" + "s/" * 500, "com/", "allow"),
    }
    pages = spark.createDataFrame([(u, 1) for u in [*urls, *urls]], "url string, host int")
    for options in ({}, {"max_broadcast_bytes": 0}):
        rows = url_trie.filter_urls(pages, spark.createDataFrame(RULES, url_trie.RULE_SCHEMA), **options).collect()
        assert len(rows) == 2 * len(urls)
        assert all((r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]] for r in rows)
    assert url_trie.filter_urls(pages.limit(0), spark.createDataFrame(RULES, url_trie.RULE_SCHEMA)).count() == 0


def test_pipeline_stages(spark: SparkSession, labelled: DataFrame) -> None:
    docs, sf_dir = labelled, "/root/testdata/sf0.01"
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].schema.fieldNames() == docs.schema.fieldNames(), name
    assert kept[1].count() >= 0.98 * docs.count()
    rows = kept[2].collect()
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for line in r["text"].split("\n"):
            if len(line.split()) >= 12:  # a shorter line stays where it crosses the alignment
                assert seen.setdefault(line, r["doc_id"]) == r["doc_id"]
    links, _ = classes_of([r["text"] for r in kept[3].orderBy("doc_id").limit(400).collect()])
    assert not any(links)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[3], sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept[3].collect()}


def test_pipeline_stages_on_odd_documents(spark: SparkSession) -> None:
    """Nulls, empty and very long texts, repeated rows, ties and clashing names pass every stage; what a stage keeps is as it
    was but for the deleted lines."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = real.where("lang = 'en' AND n_chars > 400").orderBy("doc_id").first()["text"]
    long = "\n".join(" ".join(some.split()[k % 50 : k % 50 + 8] + [f"w{k}"]) for k in range(12_000))
    rows = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, " \n ", None, None, 3), (900_003, "12 34", "en", "s", 5), (900_004, long, None, "s", len(long)), (900_005, some + " it was", "en", None, 9), (900_005, some + " it was", "en", None, 9), (None, some + " she said to the other", None, None, None)]
    clash = {c: F.lit(c) for c in ("lang_pred", "score", "n_lines", "n_deleted", "set", "tokens", "cluster", "doc", "th", "key", "row", "piece", "length", "rank", "salt", "token", "first")}
    docs = real.unionByName(spark.createDataFrame(rows, SCHEMA)).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "").cache()
        assert kept.columns == [c for c in docs.columns], name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert 900_001 not in ids and 900_003 not in ids and 900_004 in ids, name
        assert ids.count(900_005) == (1 if name == "near_duplicates" else 2), name
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    held: dict = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for own in held.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
