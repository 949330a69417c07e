"""Ranking of many queries at once by matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

#: So many numbers of a matrix of similarities, and so many found facets, are held at once: fixed values, of some 50 MB each.
PRODUCT, FOUND = 4_000_000, 2_000_000


def rank_facets(instances: DataFrame, queries: DataFrame, limit: int, block_rows: int = 100_000, query_rows: int = 8_000) -> DataFrame:
    """(query_id, entity_id, rank): the entities with the most similar fragment at nine places, ties to the smaller id.

    instances has entity_id and vector, queries query_id and vector: a search of one fragment without variants or popularity."""
    one, none = F.lit("").alias("model"), F.lit(None).cast("double").alias("popularity")
    known = instances.select(one, F.col("entity_id").alias("facet"), "vector", none)
    asked = queries.select(one, "query_id", F.lit(0).alias("fragment"), "vector")
    found = _ranked(known, asked, limit, block_rows, query_rows, lambda x: np.round(x, 9))
    return found.select("query_id", F.col("facet").alias("entity_id"), "rank")


def score_models(instances: DataFrame, queries: DataFrame, popularity: DataFrame, limit: int = 100, block_rows: int = 100_000, query_rows: int = 8_000) -> DataFrame:
    """score_queries for several models in one plan: instances, queries and the result have a column model beside the others, and a
    query meets the vectors of its model only.  Queries are dealt to the same sets whatever the model."""
    return _scored(instances, queries, popularity, limit, block_rows, query_rows)


def score_queries(instances: DataFrame, queries: DataFrame, popularity: DataFrame, limit: int = 100, block_rows: int = 100_000, query_rows: int = 8_000) -> DataFrame:
    """(query_id, facet, score, rank): the facets of each query in the order of a search for its fragments.

    instances has facet and vector; queries has query_id, fragment and vector, a row for each variant of a fragment; popularity
    has facet and popularity.  A facet's score is the mean over the query's fragments of the best similarity of any variant to any of
    its instances; facets are ordered by the score at four places, then by popularity (zero and null last), then by themselves.
    Blocks of facets meet blocks of queries, and only a block's best facets of each query go on."""
    one = F.lit("").alias("model")
    return _scored(instances.select("*", one), queries.select("*", one), popularity, limit, block_rows, query_rows).drop("model")


def _scored(instances: DataFrame, queries: DataFrame, popularity: DataFrame, limit: int, block_rows: int, query_rows: int) -> DataFrame:
    known = instances.join(popularity.select("facet", F.nullif(F.col("popularity"), F.lit(0)).cast("double").alias("popularity")), "facet", "left")
    return _ranked(known, queries, limit, block_rows, query_rows, lambda x: np.floor(x * 1e4 + 0.5) / 1e4)


def _ranked(known: DataFrame, queries: DataFrame, limit: int, block_rows: int, query_rows: int, places: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(model, query_id, facet, score, rank) of known (model, facet, vector, popularity) and queries (model, query_id, fragment, vector).

    A pair of a block of facets and a set of queries is a group of rows, the queries first, in as many partitions as pairs, so that
    a task sorts a bounded number of rows whatever the tables.  Facets stream past the queries: of each few, only those go on that
    are no worse than the best limit so far."""
    n, m = known.count(), queries.count()
    cores = known.sparkSession.sparkContext.defaultParallelism
    sets = max(1, -(-m // query_rows))
    blocks = max(1, -(-n // block_rows), min(-(-cores // sets), n // 2_000))
    kind = "array<float>" if all(d.schema["vector"].dataType.simpleString() == "array<float>" for d in (known, queries)) else "array<double>"
    empty = lambda rows, name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    vector = F.col("vector").cast(kind).alias("vector")
    own = known.select("model", F.lit(True).alias("held"), "facet", empty(queries, "query_id"), F.lit(0).alias("fragment"), vector, "popularity", F.pmod(F.xxhash64("facet"), F.lit(blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("j"))
    ask = queries.select("model", F.lit(False).alias("held"), empty(known, "facet"), "query_id", F.col("fragment").cast("int").alias("fragment"), vector, F.lit(None).cast("double").alias("popularity"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int").alias("j"))
    dealt = own.unionByName(ask).repartition(blocks * sets, "model", "i", "j").sortWithinPartitions("model", "i", "j", "held", "facet", "query_id", "fragment")
    kinds = {"model": queries.schema["model"].dataType, "query_id": queries.schema["query_id"].dataType, "facet": known.schema["facet"].dataType, "score": DoubleType(), "places": DoubleType(), "popularity": DoubleType()}
    arrow = [to_arrow_type(t) for t in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, None
        for batch in batches:
            table = pa.table(batch)
            keys = [table.column(c) for c in ("model", "i", "j", "held")]
            for a, b in _runs(keys):
                key = tuple(c[a].as_py() for c in keys[:3])
                if key != group:
                    if at:
                        yield from packed(group, at)
                    group, at = key, _Best(limit, places)
                (at.hold if keys[3][a].as_py() else at.ask)(table.slice(a, b - a).combine_chunks())
        if at:
            yield from packed(group, at)

    def packed(group: tuple, at: _Best) -> Iterator[pa.RecordBatch]:
        for query, facet, score, place, popularity in at.found():
            columns = [pa.repeat(pa.scalar(group[0], arrow[0]), len(score)), query.cast(arrow[1]), facet.cast(arrow[2]), pa.array(score), pa.array(place), pa.array(popularity, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    found = dealt.mapInArrow(run, StructType([StructField(name, t) for name, t in kinds.items()]))
    w = Window.partitionBy("model", "query_id").orderBy(F.desc("places"), F.asc_nulls_last("popularity"), "facet")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("model", "query_id", "facet", "score", "rank")


def _starts(columns: list[pa.ChunkedArray | pa.Array]) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        parts = [c.field(k) for k in range(c.type.num_fields)] if pa.types.is_struct(c.type) else [c]
        for p in parts:
            code = p.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _runs(columns: list[pa.ChunkedArray]) -> list[tuple[int, int]]:
    starts = _starts(columns).tolist()
    return list(zip(starts, [*starts[1:], len(columns[0])], strict=True))


def _matrix(table: pa.Table) -> np.ndarray:
    vectors = table.column("vector").combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


class _Best:
    """The best facets of each of a set of queries, from facets that come in ascending order."""

    def __init__(self, limit: int, places: Callable[[np.ndarray], np.ndarray]):
        self.limit, self.places = limit, places
        self.asked: list[pa.Table] = []
        self.facets: list[pa.Array] = []  # of each part that was looked at
        self.popular: list[np.ndarray] = []
        self.n_facets, self.open = 0, None
        self.kept: list[tuple[np.ndarray, ...]] = []  # query, facet number, score
        self.n_kept, self.vectors = 0, None

    def ask(self, table: pa.Table) -> None:
        self.asked.append(table)

    def _begin(self) -> None:
        asked = pa.concat_tables(self.asked).combine_chunks()
        self.groups = _starts([asked.column("query_id"), asked.column("fragment")])
        first = _starts([asked.column("query_id")])
        self.queries = _array(asked, "query_id").take(pa.array(first))
        self.firsts = np.searchsorted(self.groups, first)
        self.sizes = np.diff([*self.firsts, len(self.groups)])
        self.vectors, self.asked = _matrix(asked), []
        self.least = np.full(len(first), -np.inf)

    def hold(self, table: pa.Table) -> None:
        if not self.asked and self.vectors is None:
            return
        if self.vectors is None:
            self._begin()
        step = max(1, PRODUCT // len(self.vectors))
        for k in range(0, table.num_rows, step):
            self._part(table.slice(k, step).combine_chunks())

    def _part(self, table: pa.Table) -> None:
        """Similarities of a few instances; the last facet stays open, as more of its instances may come."""
        sims = _matrix(table) @ self.vectors.T
        starts = _starts([table.column("facet")])
        best = np.maximum.reduceat(sims, starts, axis=0)
        facets = _array(table, "facet").take(pa.array(starts))
        popular = table.column("popularity").to_numpy()[starts].astype(np.float64)
        if self.open is not None:
            if self.open[0][0].as_py() == facets[0].as_py():
                np.maximum(best[0], self.open[2][0], out=best[0])
            else:
                self._judge(*self.open)
        if len(starts) > 1:
            self._judge(facets[:-1], popular[:-1], best[:-1])
        self.open = facets[-1:], popular[-1:], best[-1:].copy()

    def _judge(self, facets: pa.Array, popular: np.ndarray, best: np.ndarray) -> None:
        """Keeps what may be among the best limit of a query: a facet below its query's least place is behind limit others."""
        if len(self.groups) < len(self.vectors):
            best = np.maximum.reduceat(best, self.groups, axis=1)
        score = np.add.reduceat(best, self.firsts, axis=1) / self.sizes if len(self.firsts) < len(self.groups) else best
        place = self.places(score)
        least = self.least
        if len(facets) > 2 * self.limit:
            least = np.maximum(least, np.partition(place, len(facets) - self.limit, axis=0)[len(facets) - self.limit])
        facet, query = np.nonzero(place >= least)
        self.kept.append((query, facet + self.n_facets, score[facet, query]))
        self.facets.append(facets)
        self.popular.append(popular)
        self.n_facets += len(facets)
        self.n_kept += len(query)
        if self.n_kept > FOUND and self.n_kept > 2 * self.limit * len(self.least):
            self._reduce()

    def _reduce(self) -> None:
        query, facet, score = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        place = self.places(score)
        popular = np.concatenate(self.popular)
        self.popular = [popular]
        order = np.lexsort((facet, np.nan_to_num(popular[facet], nan=np.inf), -place, query))
        query, facet, score, place = query[order], facet[order], score[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.limit - 1
        self.least[query[last]] = place[last]
        few = rank < self.limit
        self.kept, self.n_kept = [(query[few], facet[few], score[few])], int(few.sum())

    def found(self) -> Iterator[tuple]:
        """(queries, facets, scores, places, popularities) in parts."""
        if self.open is None:
            return
        self._judge(*self.open)
        self._reduce()
        facets, popular = pa.concat_arrays(self.facets), self.popular[0]
        query, facet, score = self.kept[0]
        for k in range(0, len(query), 100_000):
            q, f, s = query[k : k + 100_000], facet[k : k + 100_000], score[k : k + 100_000]
            yield self.queries.take(pa.array(q)), facets.take(pa.array(f)), s, self.places(s), popular[f]
