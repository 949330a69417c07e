"""Near-duplicate vectors by a forest of random-projection trees: recursive splits with spill overlap across several trees,
exact comparison inside the leaves, and the union of the verified links.  Links are never written as pairs: a group of leaves
gives a spanning forest of its links, and the components that the forests join are compared once more to count the links.

The top of every tree is fitted on a bounded sample (sample_vectors rows by hash): a node splits at the median of the
sample's projections on its level's random direction, and vectors within spill of the threshold go to both sides, so that a
linked pair is rarely cut apart.  Nodes of the top that hold too many rows for a task are split on, level by level, at medians
computed over all their rows.  A task takes a node of the top and splits it on in memory down to leaf_vectors; rows that no
projection tells apart are compared whole, in pairs of blocks where they are too many for a task.  All rows go through all
trees.

Disk holds the distinct vectors once, in the type of the column.  Copies of them, for spill, trees and pairs of blocks, are
shuffled in passes of at most about as many bytes, and a pass's shuffle is dropped when its links are written.

Vectors equal in every component are one class from the start; every class takes part once and counts as many links as it has
rows.  Links are exact: cosine in double precision, at least the threshold.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, have component_id =
vec_id and are kept; vectors of different lengths aren't linked; rows with equal vec_id are vectors of their own; an empty
table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .block_pairs import forest_steps
from .components import components
from .shared import discard, settle
from .vectors import takes_part

#: Types of components that a 32-bit float holds exactly.
NARROW = ("array<float>", "array<smallint>", "array<tinyint>")


def vector_type(table: DataFrame) -> str:
    """The numpy type in which the components of embedding are kept."""
    return "float32" if table.schema["embedding"].dataType.simpleString() in NARROW else "float64"


def digested(table: DataFrame, vectors: bool) -> DataFrame:
    """(vec_id, key[, vector]): vector is the components as bytes and key a digest of them, null where a vector takes no part."""
    kind = vector_type(table)
    x = F.col("embedding").cast("array<float>" if kind == "float32" else "array<double>")
    usable = takes_part(x) & F.exists(x, lambda e: e != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            raw = (np.asarray(x.flatten(), dtype=kind) + np.zeros(1, dtype=kind)).tobytes()  # one zero only
            ends = np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * np.dtype(kind).itemsize
            parts = [raw[a:b] if b > a else None for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
            keys = pa.array([None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in parts], pa.binary())
            columns = [batch.column("vec_id"), keys, *([pa.array(parts, pa.binary())] if vectors else [])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "vector"][: len(columns)])

    return rows.mapInArrow(run, "vec_id long, key binary" + ", vector binary" * vectors)


def packed(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The lengths of a binary column's values, and all of them one behind the other."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(ends), memoryview(column.buffers()[2])[ends[0] : ends[-1]]


def read_vectors(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a binary column without nulls, for each number of components in it."""
    lengths = packed(column)[0] if len(column) else np.zeros(0, dtype=np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, units(packed(column if len(rows) == len(lengths) else column.take(pa.array(rows)))[1], len(rows), kind)


def units(raw: bytes | memoryview, n: int, kind: str) -> np.ndarray:
    """n vectors of one length as unit vectors in double precision."""
    x = np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


#: Spill as a multiple of the spread that the difference of two vectors at the threshold has on a random direction.  A pair is parted
#: by a split only if its difference there is over twice the spill, and the cut between: at 0.76 five trees meet over 0.99 of the
#: pairs at the threshold, at about three copies of a vector in each, whatever the number of components.
SPILL = 0.76
#: A node of which a side would keep a larger share of the rows isn't split.
STUCK = 0.8
#: Bytes of unit vectors in a task at once, of a shuffle that isn't worth cutting into passes, and vectors in a block of a component.
GROUP_BYTES, LEAST_PASS, BLOCK = 64_000_000, 64_000_000, 8192


def spill_of(threshold: float, components: int, spill: float = SPILL) -> float:
    """The distance from a cut within which unit vectors of so many components go to both sides."""
    return spill * float(np.sqrt((2 - 2 * threshold) / max(components, 1)))


def direction(size: int, *seed: int) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=size)
    return d / max(float(np.linalg.norm(d)), 1e-300)


class Tree:
    """One tree's top: a direction for each level, and for each node a threshold and the number of its left child, before its right
    one; a node without a child is a leaf."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, least: int = 16, spill: float = 0.0):
        """Splits nodes with least rows of the sample or more, down to depth; with spill the sample goes to both sides as the rows will."""
        self.seed, self.size = seed, sample.shape[1]
        self.thresholds, self.child, self.level, self.directions = [np.nan], [0], [0], []
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if len(own) < max(least, 2) or self.level[node] >= depth:
                continue
            at = sample[own] @ self.at_level(self.level[node])
            cut = float(np.median(at))
            left, right = own[at <= cut + spill], own[at > cut - spill]
            if max(len(left), len(right)) <= STUCK * len(own):
                self.split(node, cut)
                todo += [(self.child[node], left), (self.child[node] + 1, right)]

    def at_level(self, level: int) -> np.ndarray:
        while len(self.directions) <= level:
            self.directions.append(direction(self.size, self.seed, self.size, len(self.directions)))
        return self.directions[level]

    def split(self, node: int, cut: float) -> None:
        self.thresholds[node], self.child[node] = cut, len(self.child)
        self.thresholds += [np.nan, np.nan]
        self.child += [0, 0]
        self.level += [self.level[node] + 1] * 2
        self.at_level(self.level[node])

    def ways_to(self, leaves: set[int]) -> np.ndarray:
        """Whether each node is one of the leaves or on the way to one; children come behind their parents."""
        on = np.array([k in leaves for k in range(len(self.child))])
        for k in range(len(on) - 1, -1, -1):
            if self.child[k]:
                on[k] = on[self.child[k]] | on[self.child[k] + 1]
        return on

    def leaves(self, vectors: np.ndarray, spill: float, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a vector belongs to, or of those on the way that on says."""
        rows, nodes, done = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64), []
        thresholds, child = np.array(self.thresholds), np.array(self.child)
        for level in range(len(self.directions) + 1):
            if on is not None:
                rows, nodes = rows[on[nodes]], nodes[on[nodes]]
            inner = child[nodes] > 0
            done.append((rows[~inner], nodes[~inner]))
            rows, nodes = rows[inner], nodes[inner]
            if not len(rows):
                break
            at = (vectors @ self.directions[level])[rows] - thresholds[nodes]
            left, right = at <= spill, at > -spill
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([child[nodes[left]], child[nodes[right]] + 1])
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def first_trees(classes: DataFrame, kind: str, n: int, trees: int, leaf_vectors: int, sample_vectors: int, max_depth: int, spread: tuple[float, float]) -> list[Tree]:
    """The tops fitted on the sample, for each number of components in it; vectors that fit in a leaf need one tree only."""
    sample = [r["vector"] for r in classes.orderBy(F.xxhash64("key"), "key").limit(sample_vectors).select("vector").collect()]
    forest = []
    for length in sorted({len(v) for v in sample}):
        own = [v for v in sample if len(v) == length]
        x = units(b"".join(own), len(own), kind)
        most, rows = group_size(x.shape[1], n, leaf_vectors), n / len(sample)
        for seed in range(1 if n <= leaf_vectors else trees):
            forest.append(Tree(x, max_depth, seed, max(16, int(most / rows) + 1), spill_of(spread[0], x.shape[1], spread[1])))
    return forest


def group_size(size: int, n: int, leaf_vectors: int) -> int:
    """Rows of a node of the top that a task takes: a sixteenth of all, as many as its memory is meant to hold at most."""
    return max(leaf_vectors, min(n // 16, GROUP_BYTES // (8 * max(size, 1))))


def counted(classes: DataFrame, kind: str, forest: list[Tree], spread: tuple[float, float]) -> dict[tuple[int, int], int]:
    """Rows of each (tree, leaf), and of (-1, components) for vectors of a length that has no tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for rows, x in read_vectors(batch.column("vector"), kind):
                own = [t for t, tree in enumerate(forest) if tree.size == x.shape[1]]
                found = [(t, *np.unique(forest[t].leaves(x, spill_of(spread[0], x.shape[1], spread[1]))[1], return_counts=True)) for t in own]
                for t, nodes, counts in found or [(-1, np.array([x.shape[1]]), np.array([len(rows)]))]:
                    for node, m in zip(nodes.tolist(), counts.tolist(), strict=True):
                        seen[t, node] = seen.get((t, node), 0) + m
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.int64()), pa.array([k for _, k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["tree", "node", "n"])

    # a row for each node of the tops, of which there is one for some thousands of vectors
    found = classes.select("vector").mapInArrow(run, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    return {(r["tree"], r["node"]): r["n"] for r in found.collect()}


def medians(classes: DataFrame, kind: str, forest: list[Tree], wanted: dict[int, set[int]], spread: tuple[float, float]) -> dict[tuple[int, int], float]:
    """The median, over all rows of each wanted leaf, of their projections on the direction of its level."""
    on = {t: forest[t].ways_to(nodes) for t, nodes in wanted.items()}
    for t, nodes in wanted.items():
        forest[t].at_level(max(forest[t].level[k] for k in nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in read_vectors(batch.column("vector"), kind):
                for t in on:
                    tree = forest[t]
                    if tree.size == x.shape[1]:
                        rows, nodes = tree.leaves(x, spill_of(spread[0], tree.size, spread[1]), on[t])
                        levels = np.array(tree.level)[nodes]
                        at = np.zeros(len(rows))
                        for level in np.unique(levels):
                            own = levels == level
                            at[own] = (x @ tree.directions[level])[rows[own]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t)), pa.array(nodes), pa.array(at)], ["tree", "node", "at"])

    found = classes.select("vector").mapInArrow(run, "tree long, node long, at double").groupBy("tree", "node").agg(F.percentile_approx("at", 0.5, 1000).alias("cut"))
    return {(r["tree"], r["node"]): r["cut"] for r in found.collect()}


def grown(classes: DataFrame, kind: str, forest: list[Tree], n: int, trees: int, leaf_vectors: int, spread: tuple[float, float], max_levels: int = 40) -> dict[tuple[int, int], int]:
    """Rows of each (tree, leaf), after leaves with more rows than two groups are split on as far as projections tell them apart."""
    whole: set[tuple[int, int]] = set()
    sizes = counted(classes, kind, forest, spread)
    for size, m in [(k, m) for (t, k), m in sizes.items() if t < 0]:
        for seed in range(1 if m <= leaf_vectors else trees):
            sizes[len(forest), 0] = m
            forest.append(Tree(np.zeros((0, size)), 0, seed))
    sizes = {k: m for k, m in sizes.items() if k[0] >= 0}
    for _ in range(max_levels):
        wanted: dict[int, set[int]] = {}
        for (t, node), m in sizes.items():
            if m > 2 * group_size(forest[t].size, n, leaf_vectors) and (t, node) not in whole:
                wanted.setdefault(t, set()).add(node)
        if not wanted:
            break
        for (t, node), cut in medians(classes, kind, forest, wanted, spread).items():
            forest[t].split(node, cut)
        before, sizes = sizes, counted(classes, kind, forest, spread)
        for t, nodes in wanted.items():
            for node in nodes:
                child = forest[t].child[node]
                if max(sizes.get((t, child), 0), sizes.get((t, child + 1), 0)) > STUCK * before[t, node]:
                    forest[t].child[node] = 0  # its children are reached no more
                    whole.add((t, node))
                    sizes[t, node] = before[t, node]
                    sizes.pop((t, child), None)
                    sizes.pop((t, child + 1), None)
    return sizes


def passes(sizes: dict[tuple[int, int], int], forest: list[Tree], n: int, leaf_vectors: int, row_bytes: float, most_bytes: float) -> Iterator[dict[tuple[int, int], tuple[int, int, int]]]:
    """Of each pass, for each (tree, leaf) the number of blocks and the first and last (excluded) pair of blocks, i * blocks + j."""
    held, now = 0.0, {}
    for (t, node), m in sorted(sizes.items()):
        most = 2 * group_size(forest[t].size, n, leaf_vectors)
        blocks = 1 if m <= most else -(-2 * m // most)
        for i in range(blocks):
            for j in range(i, blocks):
                size = row_bytes * m / blocks * (1 + (i < j))
                if now and held + size > most_bytes:
                    yield now
                    held, now = 0.0, {}
                held, at = held + size, i * blocks + j
                now[t, node] = (blocks, now[t, node][1] if (t, node) in now else at, at + 1)
    if now:
        yield now


def routed(classes: DataFrame, kind: str, forest: list[Tree], plan: dict[tuple[int, int], tuple[int, int, int]], spread: tuple[float, float]) -> DataFrame:
    """(unit, side, id, vector) of a pass: a unit is a pair of blocks of a leaf, side is 1 for the second of two different blocks."""
    on = {t: forest[t].ways_to({k for u, k in plan if u == t}) for t in {t for t, _ in plan}}
    numbers = {k: u for u, k in enumerate(plan)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("id").to_numpy(), []
            for place, x in read_vectors(batch.column("vector"), kind):
                for t in on:
                    if forest[t].size != x.shape[1]:
                        continue
                    rows, nodes = forest[t].leaves(x, spill_of(spread[0], x.shape[1], spread[1]), on[t])
                    rows = place[rows]
                    for node in np.unique(nodes).tolist():
                        own, (blocks, first, last) = rows[nodes == node], plan[t, node]
                        block = ids[own] % blocks
                        for other in range(blocks):
                            i, j = np.minimum(block, other), np.maximum(block, other)
                            within = (i * blocks + j >= first) & (i * blocks + j < last)
                            out.append((own[within], ((numbers[t, node] << 40) + i * blocks + j)[within], ((block > other))[within]))
            if out:
                at, unit, side = (np.concatenate(c) for c in zip(*out, strict=True))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(side.astype(np.int32)), batch.column("id").take(at), batch.column("vector").take(at)], ["unit", "side", "id", "vector"])

    return classes.select("id", "vector").mapInArrow(run, "unit long, side int, id long, vector binary")


class Links:
    """Links between rows of unit vectors: found in single precision, and in double precision where that could be wrong."""

    def __init__(self, x: np.ndarray, threshold: float):
        self.x, self.single, self.threshold = x, x.astype(np.float32), threshold
        self.doubt = (x.shape[1] + 8) * 2.0**-23

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """The matrix of links of rows a and b, or None where there is none."""
        near = self.single[a] @ self.single[b].T
        if near.max(initial=-1.0) < self.threshold - self.doubt:
            return None
        linked = near >= self.threshold - self.doubt
        at = np.flatnonzero(linked)
        at = at[near.ravel()[at] < self.threshold + self.doubt]
        for k in range(0, len(at), 65_536):
            p, q = np.divmod(at[k : k + 65_536], len(b))
            linked[p, q] = np.einsum("ij,ij->i", self.x[a[p]], self.x[b[q]]) >= self.threshold
        return linked


class Spanning:
    """A spanning forest of links as they are found."""

    def __init__(self, n: int):
        self.root, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def one(self, rows: np.ndarray) -> int | None:
        """The root that all rows have, if it is one."""
        first = self.find(int(rows[0]))
        return first if all(self.find(x) == first for x in rows.tolist()) else None

    def compare(self, links: Links, a: np.ndarray, b: np.ndarray, tile: int = 512) -> None:
        """Adds the links of rows a and b, tile by tile; tiles of which all rows are joined already are left out."""
        same = a is b
        left, right = ([side[k : k + tile] for k in range(0, len(side), tile)] for side in (a, b))
        joined: dict[int, int] = {}  # a row of each tile of which all rows are known to be joined

        def known(k: int, rows: np.ndarray) -> int | None:
            if k not in joined and (root := self.one(rows)) is not None:
                joined[k] = root
            return self.find(joined[k]) if k in joined else None

        for i, x in enumerate(left):
            for j in range(i if same else 0, len(right)):
                y, at = right[j], j if same else len(left) + j
                if i in joined and at in joined and self.find(joined[i]) == self.find(joined[at]):
                    continue
                linked = links.between(x, y)
                if linked is None:
                    continue
                inner = same and i == j
                if inner:
                    np.fill_diagonal(linked, False)
                few = np.count_nonzero(linked) <= 4 * sum(linked.shape)
                for p, q in zip(*(c.tolist() for c in np.nonzero(linked)), strict=True) if few else forest_steps(linked, inner):
                    p, q = int(x[p]), int(y[q])
                    r, s = self.find(p), self.find(q)
                    if r != s:
                        self.root[max(r, s)] = min(r, s)
                        self.edges.append((p, q))
                known(i, x)
                known(at, y)


def leaf_rows(x: np.ndarray, leaf_vectors: int, width: float, seed: int) -> Iterator[np.ndarray]:
    """The rows of every leaf below a node of the top: splits at medians, with spill, until a leaf has leaf_vectors or doesn't shrink."""
    at: list[np.ndarray] = []
    todo = [(np.arange(len(x)), 0)]
    while todo:
        rows, level = todo.pop()
        if len(rows) > leaf_vectors:
            if level == len(at):
                at.append(x @ direction(x.shape[1], seed, x.shape[1], 1, level))
            here = at[level][rows]
            cut = np.median(here)
            left, right = rows[here <= cut + width], rows[here > cut - width]
            if max(len(left), len(right)) <= STUCK * len(rows):
                todo += [(left, level + 1), (right, level + 1)]
                continue
        yield rows


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows that agree in the first keys columns, from batches sorted by them."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[:keys]]
        starts = np.flatnonzero(np.any([np.r_[True, c[1:] != c[:-1]] for c in columns], axis=0)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(int(c[a]) for c in columns)
            if here != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def spanning_links(dealt: DataFrame, kind: str, leaf_vectors: int, threshold: float, spill: float) -> DataFrame:
    """(a, b): a spanning forest of the links of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (unit,), rows in grouped(batches, 1):
            ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
            if len(ids) < 2:
                continue
            x = units(packed(rows["vector"].chunk(0))[1], len(ids), kind)
            links, found = Links(x, threshold), Spanning(len(ids))
            if side.any():
                found.compare(links, np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            else:
                for own in leaf_rows(x, leaf_vectors, spill_of(threshold, x.shape[1], spill), unit):
                    found.compare(links, own, own)
            if found.edges:
                a, b = np.array(found.edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def counted_links(dealt: DataFrame, kind: str, threshold: float, tile: int = 512) -> DataFrame:
    """(id, links): the rows linked to each class of a pair of blocks (root, i, j) of a component, with their multiplicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 3):
            ids, side, m = (rows[c].to_numpy() for c in ("id", "side", "m"))
            if len(ids) < 2:
                continue
            links, counts = Links(units(packed(rows["vector"].chunk(0))[1], len(ids), kind), threshold), np.zeros(len(ids), dtype=np.int64)
            a = np.flatnonzero(side == 0)
            same = len(a) == len(ids)
            b = a if same else np.flatnonzero(side == 1)
            for i in range(0, len(a), tile):
                for j in range(i if same else 0, len(b), tile):
                    x, y = a[i : i + tile], b[j : j + tile]
                    linked = links.between(x, y)
                    if linked is None:
                        continue
                    if same and i == j:
                        np.fill_diagonal(linked, False)
                    counts[x] += linked @ m[y]
                    if not same or i != j:
                        counts[y] += m[x] @ linked
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(counts[at])], ["id", "links"])

    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "id long, links long")


def in_pairs(members: DataFrame, part: int, parts: int) -> DataFrame:
    """Rows (root, blocks, id, m, vector) dealt to those pairs of their component's blocks that belong to a pass."""
    block = F.pmod(F.col("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.pmod(F.xxhash64(F.col("root"), F.least(block, j), F.greatest(block, j)), F.lit(parts)) == part)
    rows = members.withColumn("other", F.explode(others))
    return rows.select("root", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), (block > F.col("other")).cast("int").alias("side"), "id", "m", "vector")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of a query go when it ends, and not when the driver's memory happens to be cleared."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(
    table: DataFrame, threshold: float = 0.95, trees: int = 5, leaf_vectors: int = 1024, sample_vectors: int = 8192, max_depth: int = 20, spill: float = SPILL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    The leaves give a spanning forest of their links, not the pairs, so a dense group of n vectors is n - 1 edges.  Its
    components are then compared once, again in pairs of blocks, for the number of links: a link never leaves a component."""
    with shuffles_dropped(table.sparkSession):
        return _near_duplicates(table, threshold, trees, leaf_vectors, sample_vectors, max_depth, spill)


def _near_duplicates(table: DataFrame, threshold: float, trees: int, leaf_vectors: int, sample_vectors: int, max_depth: int, spill: float) -> DataFrame:
    kind, spread = vector_type(table), (threshold, spill)
    own = settle(digested(table, vectors=False), "vectors")
    rows = digested(table, vectors=True).where(F.col("key").isNotNull())
    classes = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    n, row_bytes = classes.agg(F.count("*"), F.avg(F.octet_length("vector")) + 20).first()
    most_bytes = max(LEAST_PASS, n * (row_bytes or 0), 1)

    forest = first_trees(classes, kind, n, trees, leaf_vectors, sample_vectors, max_depth, spread)
    sizes = grown(classes, kind, forest, n, trees, leaf_vectors, spread)
    plans = passes(sizes, forest, n, leaf_vectors, row_bytes, most_bytes)
    found = [settle(spanning_links(routed(classes, kind, forest, plan, spread), kind, leaf_vectors, threshold, spill), "vector-forest") for plan in plans]
    edges = reduce(DataFrame.unionByName, found) if found else table.sparkSession.createDataFrame([], "a long, b long")
    joined = components(edges)
    roots = joined.select(F.col("node").alias("id"), "root")
    discard(*found)

    # only components of several blocks are looked up; there is at most one of them for BLOCK vectors
    sized = roots.groupBy("root").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    large = settle(sized.where("blocks > 1"), "component-sizes")
    more = large.agg(F.coalesce(F.sum(F.col("n") * (F.col("blocks") - 1)), F.lit(0))).first()[0]
    parts = int(np.ceil((roots.count() + more) * (row_bytes or 0) / most_bytes)) or 1
    members = classes.join(roots, "id").join(large.select("root", "blocks"), "root", "left").select("root", F.coalesce("blocks", F.lit(1)).alias("blocks"), "id", "m", "vector")
    names = classes.select("id", "key", "m", "vec_id")
    counts = []
    if parts > 1:
        members, names = settle(members, "component-members"), settle(names, "vector-names")
        discard(classes)
    for part in range(parts):
        counts.append(settle(counted_links(in_pairs(members, part, parts), kind, threshold), "vector-links"))
    discard(members)
    links = reduce(DataFrame.unionByName, counts).groupBy("id").agg(F.sum("links").alias("links"))
    smallest = names.join(roots, "id").groupBy("root").agg(F.min("vec_id").alias("smallest"))
    result = names.join(roots.join(smallest, "root"), "id", "left").join(links, "id", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    result = settle(result.select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id")), "vector-found")
    discard(classes, names, joined, large, *counts)
    linked = own.where(F.col("key").isNotNull()).select("vec_id", "key").join(result, "key").select("vec_id", "n_links", "component_id")
    alone = own.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
