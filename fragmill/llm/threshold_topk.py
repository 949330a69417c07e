"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks by hash; there are as many as keep a block within a number of bytes, whatever the vectors'
length.  A block keeps its rows in one sorted list per dimension; for a query it reads all
lists in step from the end that the query's sign favours, scores every row it meets by random access, and stops when the sum
of the contributions of the values last read can't beat the k-th score found (an equal one could still win by its smaller
id, so the scan goes on while the bound is equal).  The depth doubles from one step to the next, and the bound is computed
at the depths reached only.  A block's own k best of each query are
merged over all blocks.

Scores are exact integers.  Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as
queries or candidates; vectors of different lengths aren't compared; candidates with the query's id are left out; repeated
rows of a candidate are ranked one after another, of a query once; ties go to the smaller vec_id; a query with fewer than k
candidates gets them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .vectors import takes_part

RESULT = "query_id long, vec_id long, score long"
#: What a block holds of a component: the whole number, the same as a double, a place in a sorted list; and of a row besides.
COMPONENT_BYTES, ROW_BYTES = 8 + 8 + 4, 200


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double; null where the vector takes no part."""
    double = vector.cast("array<double>")
    return F.when(takes_part(double), F.transform(double, lambda x: F.floor(x * scale)))


class Block:
    """Candidate rows with their sorted lists; rows are in ascending order of id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)  # ascending
        self.largest = float(np.abs(self.rows).max(initial=0)) * rows.shape[1]
        self.as_kind = {np.float64: self.rows.astype(np.float64)}
        self.entries_read = 0  # of all lists, by all queries

    def numbers(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and rows as doubles where all sums are exact in them, else as integers of any size."""
        kind = np.float64 if self.largest * float(np.abs(query).max(initial=0)) < 2**52 else object
        if kind not in self.as_kind:
            self.as_kind[kind] = self.rows.astype(kind)
        return query.astype(kind), self.as_kind[kind]

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own."""
        n = len(self.ids)
        query, rows = self.numbers(query)
        use_up, use_down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        seen = np.zeros(n, dtype=bool)
        at, depth = np.zeros(0, dtype=np.int64), min(n, max(4, k))
        read = 0
        scores = np.zeros(0, dtype=query.dtype)
        while True:
            met = np.zeros(n, dtype=bool)
            met[self.lists[read:depth, use_up].ravel()] = True
            met[self.lists[n - depth : n - read, use_down].ravel()] = True
            self.entries_read += (depth - read) * (len(use_up) + len(use_down))
            if depth == n:
                met[:] = True  # all lists are read to their ends
            met &= ~seen & (self.ids != query_id)
            new = np.flatnonzero(met)
            seen |= met
            at, scores = np.concatenate([at, new]), np.concatenate([scores, rows[new] @ query])
            order = np.argsort(at, kind="stable")  # rows stand in ascending order of id, so ties go to the smaller one
            order = order[np.argsort(-scores[order], kind="stable")][:k]
            at, scores = at[order], scores[order]
            if depth == n:
                return self.ids[at], scores
            if len(at) == k:
                # the highest score of a row that no list has shown so far: each list gives the last value read
                up = rows[self.lists[depth - 1, use_up], use_up] @ query[use_up]
                down = rows[self.lists[n - depth, use_down], use_down] @ query[use_down]
                if scores[-1] > up + down:
                    return self.ids[at], scores
            read, depth = depth, min(n, 2 * depth)


def exact_top_k(table: DataFrame, query: Column, k: int = 5, scale: int = 256, block_bytes: int = 200_000_000, least_blocks: int = 64, query_rows: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each row for which query holds, among all other rows."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), query.alias("is_query"), quantized(F.col("embedding"), scale).cast("array<long>").alias("x"))
    rows = rows.where(F.col("x").isNotNull())
    held = F.sum(F.size("x").cast("long") * COMPONENT_BYTES + ROW_BYTES)
    n, n_queries, n_bytes = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.coalesce(held, F.lit(0))).first()
    # At least least_blocks blocks, so that all cores work; more as soon as a block would hold more than block_bytes.  A task
    # is a block and a group of at most about query_rows queries: large blocks keep the copies of the queries few, and groups
    # keep tasks short, at one copy of the candidates each.
    blocks, groups = max(-(-n_bytes // block_bytes), min(least_blocks, -(-n // 64)), 1), max(1, -(-n_queries // query_rows))
    deal = lambda count: F.pmod(F.xxhash64("vec_id", "x"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(F.lit(False).alias("is_query"), "vec_id", "x", deal(blocks).alias("block"), every(groups).alias("part"))
    asked = rows.where("is_query").select("is_query", "vec_id", "x").dropDuplicates(["vec_id", "x"])
    queries = asked.select("is_query", "vec_id", "x", every(blocks).alias("block"), deal(groups).alias("part"))
    ordered = candidates.unionByName(queries).repartition(blocks * groups, "block", "part").sortWithinPartitions("block", "part", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, {}, None

        def answers(wanted: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            found: list[tuple] = []
            for query_id, x in wanted:
                if len(x) in built:
                    ids, scores = built[len(x)].top(x, query_id, k)
                    found += [(query_id, i, int(s)) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
            columns = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            wanted: list[tuple[int, np.ndarray]] = []
            lists = batch.column("x")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for r, (is_query, vec_id, *group) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("is_query", "vec_id", "block", "part")), strict=True)):
                x = values[offsets[r] : offsets[r + 1]]
                if group != now:
                    if wanted:
                        yield answers(wanted)
                    wanted, now, held, built = [], group, {}, None
                if not is_query:
                    ids, xs = held.setdefault(len(x), ([], []))
                    ids.append(vec_id)
                    xs.append(x)
                    continue
                if built is None:
                    built = {size: Block(np.array(ids), np.array(xs)) for size, (ids, xs) in held.items()}
                wanted.append((vec_id, x))
            if wanted:
                yield answers(wanted)

    found = ordered.mapInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
