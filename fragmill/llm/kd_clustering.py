"""Centroid clustering in whole numbers: Lloyd's rounds that filter centroids down kd-trees.

Vectors become integers, so sums, distances and floors are exact and no result depends on how Spark deals the rows.  Every
task gathers its vectors into kd-trees of some thousand, written once as a table; a node holds its count, integer sum and
bounding box.  A round sends the centroids (clusters x components numbers) to the trees: a centroid that is farther than
another one from every point of a node's box is dropped, a node left with one centroid is assigned whole by its count and sum,
and the vectors of a leaf with several are compared with those alone.  A task passes on one sum a centroid and component.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part and aren't returned;
repeated rows are vectors of their own; a null vec_id is returned as null and hashes as empty text; of equal hashes the
smaller vector starts first; with fewer vectors than clusters there are as many centroids as vectors; an empty table gives an
empty result.  Components beyond 65,536 raise an error, as distances of such vectors don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import discard, settle
from .vectors import takes_part

#: Largest integer component: below it every sum over 64 components stays inside 64 bits.
LIMIT = 2**26
#: Below it, every term of a squared distance over up to 64 components is exact in doubles, which multiply faster.
EXACT_IN_DOUBLES = 2**21
TREES = "ids array<long>, points binary, nodes binary, boxes binary, sums binary"


class Tree:
    """Vectors in the order of the leaves; a node is (start, stop, left child or -1), its right child follows the left one."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.boxes, self.sums = points, nodes, boxes, sums

    @classmethod
    def grown(cls, points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """A tree over the points, and the order in which it holds them: nodes are halved at the median of their widest component."""
        order, nodes, boxes, sums = np.arange(len(points)), [(0, len(points), -1)], [], []
        at = 0
        while at < len(nodes):
            start, stop, _ = nodes[at]
            own = points[order[start:stop]]
            low, high = own.min(0), own.max(0)
            boxes.append((low, high))
            sums.append(own.sum(0))
            widest = int((high - low).argmax())
            if stop - start > leaf and high[widest] > low[widest]:
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(own[:, widest], middle)]
                nodes[at] = (start, stop, len(nodes))
                nodes += [(start, start + middle, -1), (start + middle, stop, -1)]
            at += 1
        return cls(points[order], np.array(nodes, dtype=np.int64), np.array(boxes), np.array(sums)), order

    def _resolved(self, centroids: np.ndarray, rows: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row among the given ones, and its squared distance; ties go to the smaller number."""
        x, c = self.points[rows], centroids[among]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_IN_DOUBLES and x.shape[1] <= 64:
            x, c = x.astype(np.float64), c.astype(np.float64)
        distance = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
        best = distance.argmin(1)
        return among[best], distance[np.arange(len(rows)), best].astype(np.int64)

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(node, whether it is assigned whole, centroids left) of nodes that cover every vector once."""
        at, left = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
        while len(at):
            low, high = self.boxes[at, 0], self.boxes[at, 1]
            # the centroid nearest to the middle of the box, among those that are left
            from_middle = (((low + high)[:, None, :] - 2 * centroids[None, :, :]) ** 2).sum(2)
            best = np.where(left, from_middle, np.iinfo(np.int64).max).argmin(1)
            # the corner of the box most in favour of a centroid: if it is nearer to the best one there, it is everywhere
            step = centroids[None, :, :] - centroids[best][:, None, :]
            corner = np.where(step > 0, high[:, None, :], low[:, None, :])
            farther = (step * (centroids[None, :, :] + centroids[best][:, None, :] - 2 * corner)).sum(2)
            left &= farther <= 0
            whole, leaf = left.sum(1) == 1, self.nodes[at, 2] < 0
            for k in np.flatnonzero(whole | leaf):
                yield int(at[k]), bool(whole[k]), np.flatnonzero(left[k])
            down = ~(whole | leaf)
            child = self.nodes[at[down], 2]
            at, left = np.concatenate([child, child + 1]), np.concatenate([left[down], left[down]])

    def _leaves(self, found: list[tuple[int, bool, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, centroids) of the leaves that are left to compare, gathered by the centroids that they have left."""
        by_left: dict[bytes, list[np.ndarray]] = {}
        for node, whole, left in found:
            if not whole:
                by_left.setdefault(left.tobytes(), []).append(np.arange(*self.nodes[node, :2]))
        for left, rows in by_left.items():
            yield np.concatenate(rows), np.frombuffer(left, dtype=np.int64)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the vectors nearest to each centroid."""
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        found = list(self.filtered(centroids))
        for node, whole, left in found:
            if whole:
                counts[left[0]] += self.nodes[node, 1] - self.nodes[node, 0]
                sums[left[0]] += self.sums[node]
        for rows, left in self._leaves(found):
            best, _ = self._resolved(centroids, rows, left)
            counts += np.bincount(best, minlength=len(counts))
            np.add.at(sums, best, self.points[rows])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every vector and its squared distance, in the tree's order."""
        best, distance = np.zeros(len(self.points), dtype=np.int64), np.zeros(len(self.points), dtype=np.int64)
        found = list(self.filtered(centroids))
        for rows, left in self._leaves([(n, False, left) for n, _, left in found]):
            best[rows], distance[rows] = self._resolved(centroids, rows, left)
        return best, distance


def integers(vector: Column, scale: int, size: int) -> Column:
    """floor(scale * x) of every component as long, or null if the vector takes no part."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    return F.when(takes_part(vector) & (F.size(vector) == size), scaled)


def _trees(rows: DataFrame, size: int, tree_rows: int, leaf: int) -> DataFrame:
    """One row a tree over the rows (vec_id, x) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def grown() -> pa.RecordBatch:
            points = np.concatenate(held)
            if np.abs(points).max() > LIMIT:
                raise ValueError(f"a component beyond {LIMIT} after scaling: its distances don't fit a long")
            tree, order = Tree.grown(points, leaf)
            row = [[[ids[k] for k in order.tolist()]], *([x.tobytes()] for x in (tree.points.astype(np.int32), tree.nodes.astype(np.int32), tree.boxes.astype(np.int32), tree.sums))]
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in row[1:])], ["ids", "points", "nodes", "boxes", "sums"])

        for whole in batches:
            for start in range(0, whole.num_rows, tree_rows):
                batch = whole.slice(start, tree_rows)
                ids += batch.column("vec_id").to_pylist()
                held.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                if len(ids) >= tree_rows:
                    yield grown()
        if ids:
            yield grown()

    return rows.mapInArrow(run, TREES)


def _read(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Scalar, Tree]]:
    for ids, points, nodes, boxes, sums in zip(*(batch.column(c) for c in ("ids", "points", "nodes", "boxes", "sums")), strict=True):
        small = [np.frombuffer(x.as_buffer(), dtype=np.int32).astype(np.int64) for x in (points, nodes, boxes)]
        yield ids, Tree(small[0].reshape(-1, size), small[1].reshape(-1, 3), small[2].reshape(-1, 2, size), np.frombuffer(sums.as_buffer(), dtype=np.int64).reshape(-1, size))


def _next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floored mean of the vectors nearest to each centroid; one without vectors stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            for _, tree in _read(batch, size):
                more, add = tree.totals(centroids)
                counts, sums = counts + more, sums + add
        cluster, place = (x.ravel() for x in np.indices((k, size)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, place, np.repeat(counts, size), sums.ravel())], ["cluster", "place", "n", "total"])

    # a long holds a task's sum, a decimal that of all tasks; what comes back are clusters x components rows
    found = trees.mapInArrow(run, "cluster long, place long, n long, total long").groupBy("cluster", "place")
    new = centroids.copy()
    for cluster, place, n, total in found.agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        if n:
            new[cluster, place] = int(total) // n
    return new


def cluster(table: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, size: int = 64, tree_rows: int = 4096, leaf: int = 32) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of vec_id and embedding."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale, size).alias("x")).where(F.col("x").isNotNull())
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["x"] for r in rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(clusters).collect()]
    trees = settle(_trees(rows, size, tree_rows, leaf), "kd-trees")
    centroids = np.array(first, dtype=np.int64).reshape(-1, size)
    for _ in range(rounds if first else 0):
        centroids = _next_centroids(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch, size):
                best, distance = tree.assigned(centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = settle(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    discard(trees)
    # one row a cluster
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    total = sum(inertia.values())
    named = [(k, inertia.get(k, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    names = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
