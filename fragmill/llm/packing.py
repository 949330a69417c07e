"""Best-fit packing of token sequences with swap-based local search.

Documents longer than a sequence are cut into pieces of the full length, the first of which may be shorter.  Which lengths
share a sequence is decided on the histogram of piece lengths, which has no more entries than a sequence has tokens whatever
the corpus: equal bins are held as one pattern with a count.  A best-fit-decreasing start is improved by local search, which
moves a piece, exchanges one for one or two for one from an underfull bin into a fuller one, always raising the sum of
squared fills, until bins empty; it stops at a proven lower bound or when no such step is left.  It goes from the patterns of most
bins down to single bins, so its steps hardly grow with the corpus and every bin is searched.  Spark then ranks the
pieces of each length, in salted groups so that a length that many pieces share isn't one group, and a piece's rank says
which sequence and offset it gets.

Edge cases: a null text counts as empty and is the end id alone; rows with equal doc_id are packed each; an empty table
gives no rows; other columns are not returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import by_bytes, settle
from .token_file import encoder_for

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document, with the crc32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder_for(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in by_bytes(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(counts: np.ndarray, capacity: int) -> list[list]:
    """Best-fit decreasing on counts[length]: bins as [number of bins, {length: pieces in each}, free tokens]."""
    by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
    present: list[int] = []  # free amounts that some bin has, ascending

    def add(n: int, held: dict, free: int) -> None:
        if not by_free[free]:
            present.insert(bisect_left(present, free), free)
        by_free[free].append([n, held, free])

    def take(free: int) -> list:
        found = by_free[free].pop()
        if not by_free[free]:
            present.pop(bisect_left(present, free))
        return found

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(present, length)
            n, held, free = take(present[at]) if at < len(present) else (left, {}, capacity)
            each = free // length
            full = min(n, left // each)
            if full:
                add(full, held | {length: each}, free - each * length)
                left -= full * each
            if full < n and held:
                if not full:
                    add(1, held | {length: left}, free - left * length)
                    left, full = 0, 1
                if full < n:
                    add(n - full, held, free)
            elif not held and left:
                add(1, {length: left}, capacity - left * length)
                left = 0
    return [b for bins in by_free for b in bins]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the tokens must fit, and so must the pieces over half of a bin beside what can't join them."""
    lengths = np.arange(capacity + 1)
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    for k in range(capacity // 2 + 1):
        large = int(counts[capacity - k + 1 :].sum())
        middle = slice(capacity // 2 + 1, capacity - k + 1)
        n_middle, t_middle = int(counts[middle].sum()), int((counts[middle] * lengths[middle]).sum())
        small = slice(max(k, 1), capacity // 2 + 1)
        t_small = int((counts[small] * lengths[small]).sum())
        best = max(best, large + n_middle + max(0, -(-(t_small - (n_middle * capacity - t_middle)) // capacity)))
    return best


def _bits(held: dict, free: int) -> tuple[int, int, int]:
    """Bit sets over token counts: what one piece gives, what one or two give, and by how much a piece given to the bin may
    exceed one it gives back."""
    items = sorted(held)
    one = sum(1 << x for x in items)
    two = one
    for i, x in enumerate(items):
        for y in items[i:]:
            if x != y or held[x] > 1:
                two |= 1 << (x + y)
    room, swap = (1 << free) - 1, 0
    for x in items:
        swap |= room << (x + 1)
    return one, two, swap


def local_search(bins: list[list], capacity: int, target: int, taken: list[int] | None = None) -> list[list]:
    """Improves bins by moves and exchanges between underfull bins until target bins are left or no step raises the sum of
    squared fills.

    Equal bins are one pattern, and a step is taken by as many bins as both patterns have, so it uses up one of them.  The search
    goes down in levels: first between patterns of at least so many bins as the largest power of two among the counts, then of
    half as many, down to single bins.  So no large pattern is used up by many small ones, and the steps follow the number of
    patterns and, slowly, the digits of the counts.  Two patterns between which there is no step are looked at once.  taken gets
    the number of steps."""
    counts: dict[tuple, int] = {}
    order: list[tuple] = []  # underfull patterns (-free, contents) of the level, the emptiest first
    born: dict[tuple, int] = {}  # the same, by when they came to be of the level
    seen: dict[tuple, int] = {}  # until when those born were looked at in vain
    bits: dict[tuple, tuple[int, int, int]] = {}
    unit, births, steps = 1 << max((n for n, _, free in bins if free), default=1).bit_length() - 1, 0, 0

    def add(key: tuple, n: int) -> None:
        nonlocal births
        counts[key] = counts.get(key, 0) + n
        if key[0] and key not in born and counts[key] >= unit:
            births += 1
            born[key] = births
            insort(order, key)
            if key not in bits:
                bits[key] = _bits(dict(key[1]), -key[0])
        elif key in born and counts[key] < unit:
            del born[key]
            order.pop(bisect_left(order, key))
        if not counts[key]:
            del counts[key]

    def partner(key: tuple) -> tuple | None:
        """The emptiest pattern, no emptier than key, that takes a step with it."""
        one, two, _ = bits[key]
        if key in seen:
            new = takewhile(lambda k: born[k] > seen[key], reversed(born))
            others = sorted(k for k in new if k[0] >= key[0])
        else:
            others = order[bisect_left(order, (key[0],)) :]
        for k in others:
            # a pattern with itself is looked at again, as its count may have been one
            if (one & ((2 << -k[0]) - 2) or two & bits[k][2]) and (k != key or counts[k] > 1):
                return k
        if counts[key] > 1 or not (one & ((2 << -key[0]) - 2) or two & bits[key][2]):
            seen[key] = births
        return None

    for n, held, free in bins:
        add((-free, tuple(sorted(held.items()))), n)
    n_bins = sum(counts.values())
    while unit and n_bins > target:
        improved = False
        for first in reversed(order.copy()):
            work = [first]
            while work and n_bins > target:
                key = work[-1]
                if key not in born or not (other := partner(key)):
                    work.pop()
                    continue
                give, get = _step([1, dict(key[1]), -key[0]], dict(other[1]), -other[0], capacity)
                gain, steps = sum(give) - sum(get), steps + 1
                n = min(counts[key], counts[other]) if key != other else counts[key] // 2
                left, right = (tuple(sorted(_changed(dict(k[1]), *x).items())) for k, x in ((key, (give, get)), (other, (get, give))))
                add(key, -n)
                add(other, -n)
                add((gain + other[0], right), n)
                if left:
                    add((key[0] - gain, left), n)
                    work.append((key[0] - gain, left))
                else:
                    n_bins -= n
                improved = True
        if not improved:
            unit //= 2
            for key in [k for k, n in counts.items() if n >= unit]:
                add(key, 0)
    if taken is not None:
        taken.append(steps)
    return [[n, dict(held), -free] for (free, held), n in sorted(counts.items())]


#: The search is the same for corpora of every size.
scaled_search = local_search


def _changed(held: dict, out: tuple, into: tuple) -> dict:
    new = dict(held)
    for x in out:
        new[x] -= 1
        if not new[x]:
            del new[x]
    for x in into:
        new[x] = new.get(x, 0) + 1
    return new


def _step(source: list, held: dict, free: int, capacity: int) -> tuple | None:
    """What the source gives and gets so that the other bin fills up most: a move, one for one, or two for one."""
    best, best_gain = None, 0
    items = sorted(source[1], reverse=True)
    twos = [(x, y) for i, x in enumerate(items) for y in items[i:] if x != y or source[1][x] > 1]
    # the sum of squares rises if the other bin ends fuller than the source was
    least = max(0, (capacity - source[2]) - (capacity - free))
    for give in [(x,) for x in items] + twos:
        total = sum(give)
        for get in [(), *((x,) for x in held)]:
            gain = total - sum(get)
            if best_gain < gain <= free and gain > least and (get or len(give) == 1):
                best, best_gain = (give, get), gain
    return best


def plan_runs(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a sequence, offset): the pieces of a length, by rank, fill the
    sequences from the first one on, so many in each, from the offset."""
    target = lower_bound(counts, capacity)
    bins = local_search(best_fit(counts, capacity), capacity, target)
    ranks, sequence, runs = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for n, held, _ in bins:
        offset = 0
        for length in sorted(held, reverse=True):
            runs.append((length, ranks[length], sequence, held[length], offset))
            ranks[length] += n * held[length]
            offset += held[length] * length
        sequence += n
    assert (ranks == counts).all()
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _placed_by_join(ranked: DataFrame, runs: np.ndarray, span: int = 65_536) -> DataFrame:
    """The pieces with their places by an equi-join: a run is looked up in every stretch of span ranks that it touches."""
    names = ["length", "first", "sequence", "each", "at"]
    table = ranked.sparkSession.createDataFrame(runs.tolist(), ", ".join(f"{c} long" for c in names))
    last = F.coalesce(F.lead("first").over(Window.partitionBy("length").orderBy("first")), F.lit(2**62))
    table = table.withColumn("end", last).join(ranked.groupBy("length").agg(F.max("rank").alias("most")), "length")
    stretch = F.sequence(F.floor(F.col("first") / span), F.floor(F.least(F.col("end") - 1, F.greatest("most", "first")) / span))
    table = table.withColumn("stretch", F.explode(stretch)).drop("most")
    rows = ranked.withColumn("stretch", F.floor(F.col("rank") / span)).join(table, ["length", "stretch"]).where("rank >= first and rank < end")
    past = F.col("rank") - F.col("first")
    place = [(F.col("sequence") + F.floor(past / F.col("each"))).alias("sequence_id"), (F.col("at") + past % F.col("each") * F.col("length")).alias("offset")]
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", *place)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, group_rows: int = 1000, max_broadcast_bytes: int = 64_000_000) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.  The plan is broadcast if it is no larger than
    max_broadcast_bytes and joined by stretches of ranks otherwise."""
    spark = docs.sparkSession
    pieces = settle(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[list(histogram)] = list(histogram.values())
    # equal bins are one pattern, so the plan follows the lengths and not their counts: 2,141 rows for the lengths of 10,000
    # documents and 2,523 for a thousand times as many
    plan = plan_runs(counts, capacity)

    # ranks within a length: salted groups of about group_rows rows, and the sum of the groups before
    groups = F.element_at(F.lit([int(-(-n // group_rows) or 1) for n in counts]), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    if plan.nbytes > max_broadcast_bytes:
        return _placed_by_join(ranked, plan)
    runs = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = runs.value
        width = int(plan[:, 1].max(initial=0)) + 1
        keys = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = plan[np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1]
            past = rank - run[:, 1]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            added = [pa.array(run[:, 2] + past // run[:, 3]), pa.array(run[:, 4] + past % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
