"""Removal of repeated byte strings: every byte covered by a string of a given length that starts in an earlier document too.

A string of the wanted length holds an anchor: of the shorter strings inside it, the one whose hash is least.  Equal strings
have equal anchors, so only what stands around an anchor that several documents have can repeat, and neighbouring strings
mostly share one: a run of them with its bytes is a piece.

1. Blocks of documents find their runs once; texts and runs are a table in buckets, which later steps read without a shuffle.
2. Blocks send 32 bits of every anchor to its group; those met twice come back.
3. Blocks send two hashes, the smallest and the largest document of each distinct piece at such an anchor.  Equal pieces are
   one there: whatever later document has it loses all of it.  A piece of several documents comes back with its first one.
4. Where documents disagree around an anchor, the first holder of each distinct piece sends its bytes, and all suffixes of the
   pieces of an anchor are sorted (``suffix_sort``): neighbours that share the wanted length are the same string, and the
   smallest document of a stretch of them is its first one.  An anchor with very many distinct pieces is dealt out by whole
   strings instead, which is as exact.
5. Blocks mark the strings that have an earlier document, and cut what they cover.

Anchors only route; that pieces are equal rests on 64 bits of polynomial hash beside 58 bits of the anchor's, and the suffixes
of different pieces are compared byte by byte once sorted.  Nothing is capped: texts are read in slices, blocks and groups
grow in number, and a document that comes often sends one row a block.

Edge cases: a null text is empty; texts shorter than the length lose nothing; a null doc_id comes after all others, and rows
with equal doc_id aren't earlier than each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import by_bytes, discard, new_path, remove, settle
from .suffix_sort import hash_numbers, inverse, powers, sort_suffixes

SLICE = 1 << 17
NEVER = 2**63 - 1  # stands for a null doc_id


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table, base = hash_numbers(-1 % 2**32)
    return table, powers(base, 2 * SLICE), powers(inverse(base), 2 * SLICE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchor_length(length: int) -> int:
    """About half the length; long lengths have longer anchors, so that a run has at most 63 strings."""
    return max(length // 2 - 1, length - 62, 1)


def _slices(n: int) -> Iterator[tuple[int, int]]:
    return ((s, min(n, s + SLICE)) for s in range(0, n, SLICE))


def _prefixes(data: np.ndarray) -> np.ndarray:
    table, up, _ = _numbers()
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)])


def find_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, place of the anchor after start) of the runs of strings that share an anchor; starts are those of
    the documents in data."""
    k = anchor_length(length)
    width = length - k + 1
    ends = np.append(starts[1:], len(data))
    last = ends[:, None] - 1 - np.arange(length - 1)[None, :]
    crossing = np.zeros(len(data), dtype=bool)
    crossing[last[last >= starts[:, None]]] = True
    found = []
    low = np.uint64(63)
    for s, e in _slices(len(data) - length + 1):
        prefix = _prefixes(data[s : e + length - 1])
        n = e - s
        hashes = mixed((prefix[k:] - prefix[:-k]) * _numbers()[2][: n + width - 1])
        # the place stands in the lowest bits, so the least number says where it is
        least = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[width - span : width - span + n])
        inside = ~crossing[s:e]
        anchors = least >> np.uint64(6)
        begins = inside.copy()
        begins[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        counted = np.cumsum(inside)
        count = counted[np.append(at[1:], n) - 1] - counted[at] + 1
        pieces = -(-count // width)  # a text that repeats itself can keep an anchor for long
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, count = np.repeat(at, pieces) + within * width, np.minimum(np.repeat(count, pieces) - within * width, width)
        found.append((at + s, count, (least[at].astype(np.int64) - at) & 63))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


class Block:
    """The documents of a block with their runs: their bytes one after the other, and anchor and hash of every piece."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by("row")
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        self.data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.starts, self.stops = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.ids = table.column("doc_id")
        counts, places = table.column("counts").to_pylist(), table.column("places").to_pylist()
        self.count = np.frombuffer(b"".join(counts), dtype=np.uint8).astype(np.int64)
        n_runs = np.array([len(x) for x in counts])
        strings = np.maximum(self.stops - self.starts - length + 1, 0)
        self.run = np.cumsum(self.count) - self.count + np.repeat(self.starts - (np.cumsum(strings) - strings), n_runs)
        self.doc = np.repeat(np.array(self.ids.fill_null(NEVER).to_pylist(), dtype=np.int64), n_runs)
        self.block = table.column("block")[0].as_py() if table.num_rows else None
        self.length = length
        anchor = self.run + np.frombuffer(b"".join(places), dtype=np.uint8)
        self.anchor, self.piece = np.zeros(len(self.run), dtype=np.uint64), np.zeros(len(self.run), dtype=np.uint64)
        k, unshift = anchor_length(length), _numbers()[2]
        cuts = np.searchsorted(self.run, np.arange(0, len(self.data) + SLICE, SLICE))
        for (s, e), a, b in zip(_slices(len(self.data)), cuts[:-1], cuts[1:], strict=False):
            if a < b:
                prefix = _prefixes(self.data[s : e + 2 * length])
                at, to = anchor[a:b] - s, self.run[a:b] - s
                self.anchor[a:b] = mixed((prefix[at + k] - prefix[at]) * unshift[at]) >> np.uint64(6)
                self.piece[a:b] = mixed((prefix[to + self.count[a:b] + length - 1] - prefix[to]) * unshift[to] + self.count[a:b].astype(np.uint64))


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places where it stands, in order) of every key."""
    order = np.argsort(keys, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
        yield int(keys[rows[0]]), rows


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x), dtype=kind)


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    """A table of whole numbers and byte strings, typed by a schema string."""
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields, strict=True)], [f[0] for f in fields])


def _first_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where the rows of sorted columns change."""
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


CODES = "bucket long, block long, codes binary"
PIECES = "bucket long, block long, anchors binary, pieces binary, low binary, high binary"
ANSWERS = "block long, pieces binary, first binary, wanted binary"
BYTES = "bucket long, block long, groups binary, pieces binary, docs binary, counts binary, places binary, text binary"
MASKS = "block long, pieces binary, masks binary"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _blocks(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Documents in blocks, named by their first row, with the runs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", block_bytes):
            text = batch.column("text").cast(pa.binary()).fill_null(b"")
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            starts = offsets[:-1] - offsets[0]
            at, count, place = find_runs(data, starts, length)
            cuts = np.append(np.searchsorted(at, starts), len(at)).tolist()
            count, place = count.astype(np.uint8).tobytes(), place.astype(np.uint8).tobytes()
            parts = [pa.array([x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (count, place)]
            block = pa.array([batch.column("row")[0].as_py()] * len(text), pa.int64())
            yield pa.RecordBatch.from_arrays([block, batch.column("row"), batch.column("doc_id"), text, *parts], ["block", "row", "doc_id", "text", "counts", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "block long, row long, doc_id long, text binary, counts binary, places binary")


def _key(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor above 32 more bits of it."""
    b = np.uint64(buckets)
    return ((anchor % b) << np.uint64(32)) | ((anchor // b) & np.uint64(2**32 - 1))


def _send_codes(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, length)
        keys = _key(block.anchor, buckets)
        order = np.lexsort((block.doc, keys))
        keys, docs = keys[order], block.doc[order]
        first = _first_of(keys)
        several = docs[first] != docs[np.append(first[1:], len(docs)) - 1] if len(first) else np.zeros(0, dtype=bool)
        keys = np.sort(np.concatenate([keys[first], keys[first][several]]))  # what two documents of the block have counts twice
        found = [(bucket, block.block, keys[rows].astype(np.uint32).tobytes()) for bucket, rows in _by_key(keys >> np.uint64(32))]
        return _rows(CODES, found)

    return run


def _met_twice(table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, dtype=np.uint32) for x in table.column("codes").to_pylist()]
    codes, n = np.unique(np.concatenate(lists), return_counts=True)
    codes = codes[n > 1]
    out = []
    for bucket, block, own in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), lists, strict=True):
        own = np.unique(own[_among(own, codes)])
        if len(own):
            out.append((bucket, block, own.tobytes()))
    return _rows(CODES, out)


def _send_pieces(length: int, buckets: int):
    def run(docs: pa.Table, met: pa.Table) -> pa.Table:
        if not docs.num_rows or not met.num_rows:
            return _rows(PIECES, [])
        block = Block(docs, length)
        lists = zip(met.column("bucket").to_pylist(), met.column("codes").to_pylist(), strict=True)
        wanted = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, dtype=np.uint32) for b, x in lists])
        own = np.flatnonzero(_among(_key(block.anchor, buckets), np.sort(wanted)))
        own = own[np.lexsort((block.doc[own], block.piece[own], block.anchor[own]))]
        anchor, piece, doc = block.anchor[own], block.piece[own], block.doc[own]
        first = _first_of(anchor, piece)
        anchor, piece, low, high = anchor[first], piece[first], doc[first], doc[np.append(first[1:], len(doc)) - 1]
        out = [(bucket, block.block, *(x[rows].tobytes() for x in (anchor, piece, low, high))) for bucket, rows in _by_key(anchor % np.uint64(buckets))]
        return _rows(PIECES, out)

    return run


def _answer(most_pieces: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, piece = _joined(table, "anchors", np.uint64), _joined(table, "pieces", np.uint64)
        low, high = _joined(table, "low", np.int64), _joined(table, "high", np.int64)
        sizes = [len(x) // 8 for x in table.column("pieces").to_pylist()]
        block = np.repeat(np.array(table.column("block").to_pylist(), dtype=np.int64), sizes)
        order = np.lexsort((piece, anchor))
        anchor, piece, low, high, block = (x[order] for x in (anchor, piece, low, high, block))
        same_piece, same_anchor = _first_of(anchor, piece), _first_of(anchor)
        n_piece, n_anchor = np.diff(np.append(same_piece, len(anchor))), np.diff(np.append(same_anchor, len(anchor)))
        first_of_piece = np.minimum.reduceat(low, same_piece)
        in_anchor = np.searchsorted(same_anchor, same_piece, side="right") - 1  # the anchor of each piece
        pieces = np.bincount(in_anchor, minlength=len(same_anchor))
        earliest, latest = np.full(len(same_anchor), NEVER), np.full(len(same_anchor), -(2**63))
        np.minimum.at(earliest, in_anchor, first_of_piece)
        np.maximum.at(latest, in_anchor, first_of_piece)
        disagree = np.repeat(np.where(latest > earliest, 1 + (pieces > most_pieces), 0), n_anchor)
        first = np.repeat(first_of_piece, n_piece)
        wanted = np.where(low == first, disagree, 0).astype(np.uint8)
        answered = np.flatnonzero((high > first) | (wanted > 0))
        out = [(int(b), *(x[answered[rows]].tobytes() for x in (piece, first, wanted))) for b, rows in _by_key(block[answered])]
        return _rows(ANSWERS, out)

    return run


def _send_bytes(length: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        wanted = _joined(answers, "wanted", np.uint8)
        if not docs.num_rows or not wanted.any():
            return _rows(BYTES, [])
        block = Block(docs, length)
        piece, first = _joined(answers, "pieces", np.uint64)[wanted > 0], _joined(answers, "first", np.int64)[wanted > 0]
        wanted = wanted[wanted > 0]
        # one run that holds the piece in its first document
        order = np.lexsort((block.doc, block.piece))
        order = order[_first_of(block.piece[order])]
        own = order[np.searchsorted(block.piece[order], piece)]
        group, start, count, place = block.anchor[own], block.run[own], block.count[own], np.zeros(len(own), dtype=np.int64)
        if (alone := wanted == 2).any():
            # every string by itself, in a group of its own hash
            n = np.where(alone, count, 1)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, alone = np.repeat(start, n) + place, np.repeat(alone, n)
            count = np.where(alone, 1, np.repeat(count, n))
            group, piece, first = np.repeat(group, n), np.repeat(piece, n), np.repeat(first, n)
            text = block.data[start[alone][:, None] + np.arange(length)[None, :]]
            table, up, _ = _numbers()
            group[alone] = mixed((table[text] * up[None, :length]).sum(1, dtype=np.uint64)) >> np.uint64(6)
        out = []
        for bucket, rows in _by_key(group % np.uint64(buckets)):
            size = count[rows] + length - 1
            at = np.repeat(start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            columns = (group[rows], piece[rows], first[rows], count[rows].astype(np.uint8), place[rows].astype(np.uint8), block.data[at])
            out.append((bucket, block.block, *(x.tobytes() for x in columns)))
        return _rows(BYTES, out)

    return run


def _compare_pieces(length: int):
    def run(table: pa.Table) -> pa.Table:
        group, piece, doc = _joined(table, "groups", np.uint64), _joined(table, "pieces", np.uint64), _joined(table, "docs", np.int64)
        count, place, data = _joined(table, "counts", np.uint8).astype(np.int64), _joined(table, "places", np.uint8).astype(np.uint64), _joined(table, "text", np.uint8)
        block = np.repeat(np.array(table.column("block").to_pylist(), dtype=np.int64), [len(x) for x in table.column("counts").to_pylist()])
        size = count + length - 1
        owner = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        order, same = sort_suffixes(data, np.cumsum(size) - size, owner, offset, group[owner], length)
        starts = np.flatnonzero(~same)
        first = np.repeat(np.minimum.reduceat(doc[owner][order], starts), np.diff(np.append(starts, len(order))))
        repeated = order[first < doc[owner][order]]
        masks = np.zeros(len(count), dtype=np.uint64)
        np.bitwise_or.at(masks, owner[repeated], np.uint64(1) << (place[owner[repeated]] + offset[repeated].astype(np.uint64)))
        found = np.flatnonzero(masks)
        return _rows(MASKS, [(b, piece[found[rows]].tobytes(), masks[found[rows]].tobytes()) for b, rows in _by_key(block[found])])

    return run


def _removed(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in REMOVED.split(", ")])


def _cut(length: int, keep_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _removed([])
        block = Block(docs, length)
        covered = np.zeros(len(block.data) + 1, dtype=np.int32)

        def cover(start: np.ndarray, count: np.ndarray | int) -> None:
            np.add.at(covered, start, 1)
            np.add.at(covered, start + count + length - 1, -1)

        def found_in(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Runs whose piece is among the sorted pieces, and where."""
            at = np.minimum(np.searchsorted(pieces, block.piece), max(len(pieces) - 1, 0))
            runs = np.flatnonzero(pieces[at] == block.piece) if len(pieces) else np.zeros(0, dtype=np.int64)
            return runs, at[runs] if len(pieces) else runs

        is_mask = np.array([x is not None for x in answers.column("masks").to_pylist()], dtype=bool)
        firsts, masks = answers.filter(pa.array(~is_mask)), answers.filter(pa.array(is_mask))
        piece, first = _joined(firsts, "pieces", np.uint64), _joined(firsts, "first", np.int64)
        order = np.argsort(piece)
        runs, at = found_in(piece[order])
        first = first[order][at]
        later = block.doc[runs] > first
        cover(block.run[runs[later]], block.count[runs[later]])
        own = np.zeros(len(block.run), dtype=bool)  # runs of the first document of their piece
        own[runs[~later]] = True
        piece, mask = _joined(masks, "pieces", np.uint64), _joined(masks, "masks", np.uint64)
        order = np.argsort(piece, kind="stable")
        piece, mask = piece[order], mask[order]
        if len(piece):
            each = _first_of(piece)
            piece, mask = piece[each], np.bitwise_or.reduceat(mask, each)
        runs, at = found_in(piece)
        runs, mask = runs[own[runs]], mask[at[own[runs]]]
        for bit in range(length - anchor_length(length) + 1):
            cover(block.run[runs[mask >> np.uint64(bit) & np.uint64(1) == 1]] + bit, 1)
        gone = np.cumsum(covered[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[block.starts[block.starts < len(gone)]] = gone[block.starts[block.starts < len(gone)]]
        n_gone, n_begun = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        out = []
        for doc_id, a, b in zip(block.ids.to_pylist(), block.starts.tolist(), block.stops.tolist(), strict=True):
            removed = int(n_gone[b] - n_gone[a])
            kept = block.data[a:b][~gone[a:b]].tobytes() if removed else block.data[a:b].tobytes()
            out.append((doc_id, b - a, removed, int(n_begun[b] - n_begun[a]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return _removed(out)

    return run


def dedup_substrings(docs: DataFrame, length: int = 50, keep_text: bool = False, block_bytes: int = 4_000_000, group_bytes: int = 16_000_000, most_pieces: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, and with keep_text what is kept of it as bytes.

    A group is dealt the anchors of about group_bytes of text, a bucket of the table as much; most_pieces is the number of
    distinct pieces from which on an anchor's strings are dealt out one by one."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // group_bytes))
    path, name = new_path(spark, "blocks"), f"fragmill_blocks_{uuid.uuid4().hex[:12]}"
    _blocks(docs, length, block_bytes).write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name).groupBy("block")
    met = blocks.applyInArrow(_send_codes(length, buckets), CODES).groupBy("bucket").applyInArrow(_met_twice, CODES)
    pieces = blocks.cogroup(met.groupBy("block")).applyInArrow(_send_pieces(length, buckets), PIECES)
    answers = settle(pieces.groupBy("bucket").applyInArrow(_answer(most_pieces), ANSWERS), "answers")
    texts = blocks.cogroup(answers.groupBy("block")).applyInArrow(_send_bytes(length, buckets), BYTES)
    masks = settle(texts.groupBy("bucket").applyInArrow(_compare_pieces(length), MASKS), "masks")
    none = F.lit(None).cast("binary")
    said = answers.select("block", "pieces", "first", none.alias("masks")).unionByName(masks.select("block", "pieces", none.alias("first"), "masks"))
    cut = settle(blocks.cogroup(said.groupBy("block")).applyInArrow(_cut(length, keep_text), REMOVED), "cut")
    discard(answers, masks)
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)
    return cut if keep_text else cut.drop("kept")
