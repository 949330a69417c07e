"""Similarity join of documents by the Jaccard similarity of their word n-grams: a chosen-path join.

A document is the set of hashes of its runs of n words (split at white space, lower-cased); a shorter text is one run.  Sets
are represented by 64 tokens, the minima of 64 hash functions, which two sets share in each place with a probability equal
to their similarity.  A run starts with all sets in one node; a node is split by one sampled place, or two with the
probability that makes a similar pair share 1 / threshold places on average, into one child for each token found there.
Nodes of at most brute_force sets are compared pair by pair on their tokens; a larger one whose sets
mostly have the same tokens is a group of near copies and is joined whole; other large ones are split again.  Every split may part
a similar pair, so deep nodes need more runs than shallow ones: all sets get the runs that find a pair at the threshold by
level SHALLOW, and the sets of nodes still large there get runs of their own, as many as level LEVELS needs.  A node that is
still large at that level holds sets that agree in as many sampled places, so all of it is taken as alike.  A pair is missed
only if it shares no node at level SHALLOW of the first runs or, being in a large one there, none at level LEVELS of the
second; each has half of the loss that the target recall leaves.

What the runs find are candidates.  They are joined to clusters, and in each cluster every two sets are compared exactly,
in blocks of bounded size, so links are exact and also cover pairs of a cluster that no run brought together.

Documents with the same set are one class from the start and are never paired with each other.

Edge cases: a text that is null or has no word links with nothing and is a class of its own; rows equal in doc_id and text
are two documents that link with each other; a null doc_id comes after all others; very long texts are whole sets; an empty
table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .block_pairs import LINK_ROWS, compare_blocks, link_rows
from .components import components
from .line_dedup import document_keys
from .shared import by_bytes, discard, number_at, order_key, settle

PLACES, SHALLOW, LEVELS = 64, 3, 8
#: Places that tell whether a node is dense, and the mean share of equal tokens in them from which it is.
SIGNS, DENSE = 8, 0.7
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd number, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([[1], np.full(n - 1, 0x9E3779B97F4A7C15, dtype=np.uint64)]).astype(np.uint64))


POWERS = powers(64)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of n words."""
    data = " ".join(text.lower().split()).encode()
    if not data:
        return np.zeros(0, dtype=np.uint64)
    chars = np.frombuffer(data, dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(chars == 32) + 1])
    sizes = np.diff(np.append(starts, len(chars) + 1))
    place = np.arange(len(chars)) - np.repeat(starts, sizes)[: len(chars)]
    table = POWERS if sizes.max() <= len(POWERS) else powers(int(sizes.max()))
    with np.errstate(over="ignore"):
        words = mix(np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * table[place], starts) + sizes.astype(np.uint64))
        count = max(1, len(words) - n + 1)
        runs = np.zeros(count, dtype=np.uint64)
        for j in range(min(n, len(words))):
            runs += mix(words[j : j + count] + np.uint64(j + 1) * np.uint64(0xD6E8FEB86659FD93))
        return np.unique(mix(runs + np.uint64(min(n, len(words)))))


def token_places(runs: np.ndarray) -> np.ndarray:
    """The 64 tokens of a set, as unsigned 32-bit numbers."""
    with np.errstate(over="ignore"):
        salts = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        lowest = np.full(PLACES, MASK)
        for k in range(0, len(runs), 2048):
            part = runs[k : k + 2048, None] * salts[None, :]
            lowest = np.minimum(lowest, (part ^ (part >> np.uint64(32))).min(0))
        return mix(lowest).astype(np.uint32)


def children(nodes: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Splits nodes: (row, child) for each sampled place.  A node's hash alone samples its places, so that all its sets agree."""
    with np.errstate(over="ignore"):
        first = (mix(nodes ^ np.uint64(0x51ED270B)) % np.uint64(PLACES)).astype(np.int64)
        other = (mix(nodes ^ np.uint64(0x2545F491)) % np.uint64(PLACES)).astype(np.int64)
        two = np.flatnonzero((mix(nodes ^ np.uint64(0x7FEB352D)) % np.uint64(10_000)).astype(np.float64) / 1e4 < 1 / threshold - 1)
        rows = np.concatenate([np.arange(len(nodes)), two[other[two] != first[two]]])
        place = np.concatenate([first, other[two[other[two] != first[two]]]])
        child = mix(nodes[rows] * np.uint64(0x9FB21C651E98DF25) + mix(tokens[rows, place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(40)) + np.uint64(1)))
    return rows, child


def least_places(threshold: float) -> int:
    """Places in which two sets must agree to be candidates: the mean of a pair at the threshold less six deviations, as no
    other run or level finds a pair that has fewer."""
    return int(PLACES * threshold - 6 * math.sqrt(PLACES * threshold * (1 - threshold)))


def runs_needed(threshold: float, recall: float, level: int) -> int:
    """Runs after which a pair at the threshold has shared a node at the level with the target recall.  The 64 places are the
    same in all runs, so it is the mean over the number of places in which such a pair agrees."""
    two, agree = 1 / threshold - 1, np.arange(least_places(threshold), PLACES + 1)
    weights = np.array([math.comb(PLACES, k) * threshold**k * (1 - threshold) ** (PLACES - k) for k in agree.tolist()])
    together = np.ones(len(agree))
    for _ in range(level):
        miss = 1 - agree / PLACES * together
        together = 1 - (1 - two) * miss - two * miss * miss
    if recall >= weights.sum():
        raise ValueError("the sketch of 64 places doesn't reach this recall")
    runs = 1
    while weights @ (1 - (1 - together) ** runs) < recall:
        runs += 1
    return runs


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, doc, th, set, size, tokens): set is a 16-byte digest of the n-grams, null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            columns = [
                *(batch.column(c) for c in ("doc_id", "doc", "th")),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([token_places(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "th", "set", "size", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_keys(), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, doc long, th long, set binary, size int, tokens binary")


def _children(sets: DataFrame, threshold: float, runs: list[int] | None = None) -> DataFrame:
    """(node, set, signs): the children of (node, set, tokens), or those of the roots of all runs for (set, tokens).  signs holds
    the lowest bits of eight places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = as_tokens(batch.column("tokens"))
            signs = np.packbits((tokens[:, ::PLACES // SIGNS] & 1).astype(np.uint8), axis=1, bitorder="little")[:, 0].view(np.int8)
            roots = [batch.column("node").to_numpy().view(np.uint64)] if runs is None else [np.full(len(tokens), r, dtype=np.uint64) for r in mix(np.array(runs, dtype=np.uint64))]
            for nodes in roots:
                rows, child = children(nodes, tokens, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("set").take(pa.array(rows)), pa.array(signs[rows])], ["node", "set", "signs"])

    return sets.mapInArrow(run, "node long, set binary, signs byte")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of places in which rows of tokens agree."""
    return (a == b).sum(-1)


def as_tokens(column: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), dtype=np.uint32).reshape(-1, PLACES)


def stars(sets: list[bytes], tokens: np.ndarray, least: int) -> list[tuple[bytes, bytes]]:
    """A spanning star of each group of sets that agree in enough places, by comparing all pairs."""
    root = np.arange(len(sets))
    for i in range(len(sets) - 1):
        near = (agreement(tokens[i + 1 :], tokens[i]) >= least) & (root[i + 1 :] != root[i])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    return [(sets[r], sets[k]) for k, r in enumerate(root.tolist()) if r != k]


def _compare_small(members: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (a, b) inside nodes of (node, set, tokens): a spanning star of each group of sets that agree in nearly
    as many places as similar sets do."""
    least = least_places(threshold)
    ordered = members.select("node", "set", "tokens").repartition("node").sortWithinPartitions("node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sets, tokens = None, [], []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in batches:
            for k, s, t in zip(*(batch.column(c).to_pylist() for c in ("node", "set", "tokens")), strict=True):
                if k != node:
                    if len(sets) > 1:
                        out += stars(sets, as_tokens(tokens), least)
                    node, sets, tokens = k, [], []
                if not sets or sets[-1] != s:
                    sets.append(s)
                    tokens.append(t)
            if len(out) > 5000:
                yield flush()
        if len(sets) > 1:
            out += stars(sets, as_tokens(tokens), least)
        if out:
            yield flush()

    return ordered.mapInArrow(run, "a binary, b binary")


def _nodes(members: DataFrame, brute_force: int) -> DataFrame:
    """(node, first, kind) of the nodes of (node, set, signs) with more than one set, first being the smallest.

    A node of at most brute_force sets is SMALL.  A larger one whose sets mostly have the same sign in each place, as near
    copies have, is DENSE: a share of equal tokens leaves the signs off balance by that share, other tokens leave them even."""
    counts = [F.sum(F.col("signs").bitwiseAND(1 << k).cast("boolean").cast("int")).alias(f"s{k}") for k in range(SIGNS)]
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("set").alias("first"), *counts).where("n > 1")
    off = sum((F.abs(2 * F.col(f"s{k}") / F.col("n") - 1) for k in range(SIGNS)), F.lit(0.0)) / SIGNS
    return sizes.select("node", "first", F.when(F.col("n") <= brute_force, "small").when(off >= DENSE, "dense").otherwise("large").alias("kind"))


def _search(sets: DataFrame, runs: range, levels: int, threshold: float, brute_force: int, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) found in nodes of (set, tokens) down to a level, and (first, set, tokens) of nodes still large there.

    Small nodes are compared pair by pair.  A dense one is a group of near copies, which no split would part: it is joined
    whole, and the exact comparison decides.  The rest is split.  Rows of nodes carry no tokens; they are joined to those
    sets that need them.  The written tables that the result reads are added to tables."""
    members, edges = _children(sets, threshold, list(runs)), None
    for level in range(1, levels + 1):
        members = settle(members, f"nodes-{level}")
        kept = settle(members.join(_nodes(members, brute_force), "node").select("node", "set", "first", "kind"), f"shared-nodes-{level}")
        discard(members)
        with_tokens = lambda kind: kept.where(F.col("kind") == kind).join(sets, "set")  # noqa: B023, E731
        groups = kept.where("kind = 'dense' and set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
        found = settle(_compare_small(with_tokens("small"), threshold).union(groups).distinct(), f"candidates-{level}")
        tables += [kept, found]
        edges = found if edges is None else edges.union(found)
        if kept.where("kind = 'large'").isEmpty():
            return edges, None
        if level < levels:
            members = _children(with_tokens("large").select("node", "set", "tokens"), threshold)
    return edges, with_tokens("large").select("first", "set", "tokens")


def candidate_edges(sets: DataFrame, threshold: float, recall: float, brute_force: int, tables: list[DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) that join all candidates of each cluster, from sets (set, tokens)."""
    tables = [] if tables is None else tables
    half = 1 - (1 - recall) / 2
    n_runs, more_runs = (runs_needed(threshold, half, level) for level in (SHALLOW, LEVELS))
    edges, large = _search(sets, range(1, n_runs + 1), SHALLOW, threshold, brute_force, tables)
    if large is not None:
        crowded = settle(large.select("set", "tokens").dropDuplicates(["set"]), "crowded-sets")
        tables.append(crowded)
        found, large = _search(crowded, range(n_runs + 1, n_runs + more_runs + 1), LEVELS, threshold, brute_force, tables)
        edges = edges.union(found)
    if large is not None:
        found = settle(large.where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct(), "candidates-large")
        tables.append(found)
        edges = edges.union(found)
    return edges


def exact_links(docs: DataFrame, members: DataFrame, n: int, threshold: float, block_sets: int = 256, most_blocks: int = 64, block_hashes: int = 2_000_000) -> DataFrame:
    """Compares all sets of a cluster exactly, in pairs of blocks.

    docs has doc, th and text; members has doc, th, key, size, m (documents with the set) and cluster.  Gives rows
    (a, links, b) of keys: links is the number of documents whose sets are linked to a in one pair of blocks, and (a, b) is an
    edge of a spanning forest of the links; one of the two is null.  A cluster has a block for every block_sets sets, but no
    more than most_blocks unless a block would hold more than block_hashes n-grams, so a set is sent to few blocks."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("size").alias("h"))
    blocks = F.greatest(F.least(F.ceil(F.col("k") / block_sets), F.lit(most_blocks)), F.ceil(F.col("h") / block_hashes)).cast("int")
    # only clusters of several blocks are looked up; there is at most one of them for block_sets sets
    sizes = settle(sizes.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "cluster-sizes")
    sized = members.join(sizes, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    texts = docs.join(sized, ["doc", "th"]).select("key", "m", "cluster", "blocks", "text", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data = pa.array([shingles(t, n).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "blocks", "block", "key", "m")), data], ["cluster", "blocks", "block", "key", "m", "data"])

    whole = texts.mapInArrow(to_sets, "cluster binary, blocks int, block int, key binary, m long, data binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = whole.withColumn("other", other).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "m", "data"
    )
    ordered = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key")

    def compare(group: tuple | None, rows: list) -> list[tuple]:
        def linked(left: list, right: list) -> np.ndarray:
            return similar(*([np.frombuffer(r[3], dtype=np.uint64) for r in side] for side in (left, right)), threshold)

        return compare_blocks(group, rows, linked) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        out: list[tuple] = []
        for batch in batches:
            for cluster, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "key", "m", "data")), strict=True):
                if (cluster, i, j) != group:
                    out += compare(group, rows)
                    group, rows = (cluster, i, j), []
                if not rows or rows[-1][1] != row[1]:  # a repeated row brings its set again
                    rows.append(row)
            if len(out) > 5000:
                yield link_rows(out)
                out = []
        out += compare(group, rows)
        if out:
            yield link_rows(out)

    return ordered.mapInArrow(run, LINK_ROWS)


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """True where two sets have at least the threshold's Jaccard similarity."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    common = np.zeros((len(left), len(right)))
    values, places = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(places, kind="stable")
    places, rows = places[order], rows[order]
    for at in range(0, len(values), 4096):
        a, b = np.searchsorted(places, [at, at + 4096])
        grid = np.zeros((len(left) + len(right), min(4096, len(values) - at)), dtype=np.float32)
        grid[rows[a:b], places[a:b] - at] = 1
        common += grid[: len(left)] @ grid[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common + 1e-9 >= threshold * union


def similarity_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, brute_force: int = 1024, block_sets: int = 256) -> DataFrame:
    """(doc_id, th, n_links, class_id, kept) of every document: th is the hash of its text, n_links the number of other documents whose n-grams are similar
    enough, class_id the smallest doc_id reachable by links, and kept says whether the document is the first of its class."""
    docs = docs.select("doc_id", "text")
    own = settle(document_sets(docs, n), "sets")
    classes = own.where(F.col("set").isNotNull()).groupBy("set").agg(
        F.count("*").alias("m"), F.min(F.struct("doc", "th")).alias("first"), F.first("size").alias("size"), F.first("tokens").alias("tokens")
    )
    # a class is known by its first document's key, so the smallest key reachable is that of the first document
    key = order_key(F.col("first.doc"), F.col("first.th"))
    classes = settle(classes.select("set", "m", key.alias("key"), F.col("first.doc").alias("doc"), F.col("first.th").alias("th"), "size", "tokens"), "classes")
    tables: list[DataFrame] = []
    clusters = components(candidate_edges(classes.select("set", "tokens"), threshold, recall, brute_force, tables))
    discard(*tables)
    members = classes.drop("tokens").join(clusters.select(F.col("node").alias("set"), F.col("root").alias("cluster")), "set")
    texts = docs.where(F.col("text").isNotNull()).select(*document_keys(), "text")
    links = settle(exact_links(texts, members, n, threshold, block_sets), "links")
    discard(clusters)
    roots = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    counts = links.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    root = F.coalesce("root", "key")
    found = classes.select("set", "m", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").join(counts, "key", "left")
    found = found.select("set", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), number_at(root, 0).alias("doc0"), number_at(root, 1).alias("th0"))
    found = settle(found, "class-rows")
    discard(classes, links, roots)
    alone = own.where(F.col("set").isNull()).select("doc_id", "th", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    joined = own.select("doc_id", "doc", "th", "set").where(F.col("set").isNotNull()).join(found, "set")
    class_id = F.when((F.col("doc0") == 2**63 - 1) & F.col("doc_id").isNull(), None).otherwise(F.col("doc0"))
    kept = (F.col("doc") == F.col("doc0")) & (F.col("th") == F.col("th0"))
    return joined.select("doc_id", "th", "n_links", class_id.alias("class_id"), kept.alias("kept")).union(alone)


def keep_one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """docs with one document of each class: the first by doc_id, and of rows equal in doc_id and text one."""
    names = docs.columns
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th")]
    found = similarity_join(docs, **options)
    first = found.where("kept").select(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("_doc"), F.col("th").alias("_th"), (F.col("n_links") > 0).alias("_linked")).dropDuplicates(["_doc", "_th"])
    rows = docs.select(F.struct(*names).alias("row"), *keys).join(first, ["_doc", "_th"])
    single = rows.where("not _linked").select("row.*")
    return single.union(rows.where("_linked").dropDuplicates(["_doc", "_th"]).select("row.*"))
