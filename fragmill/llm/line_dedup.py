"""Line dedup by pairwise alignment of documents that share rare lines.

A document is the sequence of its lines that aren't blank, without the white space around them; the k-th time that a line
occurs in a document is a token of its own, so a token stands at one place of a document.  What brings documents together:

* a line of at least min_words words;
* around a line with fewer words, which says little alone, each shortest run of lines that has min_words words;
* every run of 2, 4, 8, ... successive shared lines with min_words words, where a shared line is one that several documents
  hold.  However frequent its lines are, a run is as rare as the documents that hold it: what two documents alone have in
  common in a row leads from one to the other, though each line of it stands in thousands.

Every document is aligned with the first document that holds one of these, for each of them.  So the number of pairs is at
most that of lines and runs, whatever number of documents share them, and one rule holds for rare and for frequent lines.  A
shared line that crosses the alignments with all these documents stays, though one with yet another document might hold it.

A pair is aligned by patience diff over all tokens that both documents hold: lines that occur once in both are the anchors,
their longest common increasing sequence is kept, and the others fill the gaps between anchors.  A common block is a run of
aligned lines that follow each other in both documents, and blocks of at least min_words words go from the later document.
What crosses the alignment is aligned again, whole runs that follow each other in both documents at a time, without what was
aligned before, until nothing is left; a block of these later alignments, a moved one, goes if it has at least moved_words
words.  As each run gets its turn, no alignment need be computed for this: moved blocks are all the crossing runs of that
length.  In the same way what is left of the later document meets the earlier one again: where a run of deleted lines occurs once
more, it is a moved block too.  Smaller pieces stay, and so does a block that is too short.

Earlier means a smaller doc_id, then a smaller hash of the text; a null doc_id comes last.  Edge cases: a null text stays
null; rows equal in doc_id and text are one document and are treated alike; a whose lines are all deleted keeps an empty text; repeated lines within one document stay where no earlier document has as
many; an empty table gives no rows; other columns are returned as they are, but for input columns named like an output
column, which are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .shared import by_bytes, discard, settle

LAST = 2**63 - 1
#: What a row is: a line that brings documents together, one that is too short for it, a run of lines.
LINE, SHORT, RUN = 0, 1, 2
ROWS = "doc long, th long, at int, token binary, words int, kind byte, alone boolean"
MATCHES = ["doc", "th", "doc0", "th0", "at", "at0", "unique", "words"]


def document_keys() -> list[Column]:
    """doc and th tell documents apart and order them."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th")]


def kept_lines(text: str) -> list[str]:
    return [x for line in text.split("\n") if (x := line.strip())]


def runs_around(counts: list[int], at: int, min_words: int) -> Iterator[tuple[int, int]]:
    """The shortest runs [first, last] of lines with these numbers of words that hold line at and have min_words words."""
    first, last, total = at, at, counts[at]
    while first > 0 and total < min_words:
        first -= 1
        total += counts[first]
    while first <= at:
        while total < min_words and last + 1 < len(counts):
            last += 1
            total += counts[last]
        if total < min_words:
            return
        while last > at and total - counts[last] >= min_words:
            total -= counts[last]
            last -= 1
        if first == at or total - counts[first] < min_words:
            yield first, last
        total -= counts[first]
        first += 1


def tokens_of(lines: list[str], min_words: int) -> list[tuple[int, str, int, int, bool]]:
    """(place, token, words, kind, alone) of a document; a token that occurs again has its number in front, and alone says that
    the line occurs once."""
    counts, total, seen = [len(x.split()) for x in lines], Counter(lines), Counter()
    out, runs = [], set()
    for at, (line, n) in enumerate(zip(lines, counts, strict=True)):
        k = seen[line]
        seen[line] += 1
        out.append((at, f"{k}\0{line}" if k else line, n, LINE if n >= min_words else SHORT, total[line] == 1))
        if n < min_words:
            for first, last in runs_around(counts, at, min_words):
                run = "\n".join(lines[first : last + 1])
                if run not in runs and first < last:
                    runs.add(run)
                    out.append((first, "\n" + run, 0, RUN, False))
    return out


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """ROWS: the tokens of every document by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows: list[tuple] = []
            for doc, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "text")), strict=True):
                rows += [(doc, th, at, hashlib.blake2b(t.encode(), digest_size=16).digest(), words, kind, alone) for at, t, words, kind, alone in tokens_of(kept_lines(text), min_words)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int8(), pa.bool_())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "th", "at", "token", "words", "kind", "alone"])

    return docs.mapInArrow(run, ROWS)


def longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first number, whose second numbers rise."""
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(ends, b)
        back[k] = last[i - 1] if i else -1
        ends[i : i + 1] = [b]
        last[i : i + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(matches: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Patience diff of matches (place in the later document, place in the earlier one, unique in both), sorted; no place occurs
    twice.  Rising in both."""
    anchors = longest_rise([(a, b) for a, b, unique in matches if unique])
    others = [(a, b) for a, b, unique in matches if not unique]
    found, bounds, k = list(anchors), [(-1, -1), *anchors, (LAST, LAST)], 0
    for (a0, b0), (a1, b1) in zip(bounds, bounds[1:], strict=False):
        gap = []
        while k < len(others) and others[k][0] < a1:
            if others[k][0] > a0 and b0 < others[k][1] < b1:
                gap.append(others[k])
            k += 1
        found += longest_rise(gap)
    return sorted(found)


def blocks(pairs: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of places that follow each other in both documents."""
    block: list[int] = []
    for k, (a, b) in enumerate(pairs):
        if k and (a, b) != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            yield block
            block = []
        block.append(a)
    if block:
        yield block


def deleted_places(matches: list[tuple[int, int, bool, int]], min_words: int, moved_words: int) -> set[int]:
    """Places in the later document of the common blocks, from matches with their words."""
    words = {a: w for a, _, _, w in matches}
    aligned = align([m[:3] for m in matches])
    taken = set(aligned)
    crossing = [m[:2] for m in matches if m[:2] not in taken]
    out: set[int] = set()
    for pairs, least in ((aligned, min_words), (crossing, moved_words)):
        for block in blocks(pairs):
            if sum(map(words.__getitem__, block)) >= least:
                out.update(block)
    return out


def ladder(tokens: list[bytes], words: list[int], min_words: int) -> Iterator[bytes]:
    """Hashes of the runs of 2, 4, 8, ... successive tokens that have min_words words; two shorter runs give one."""
    length, sums = 1, words
    while len(tokens) > length:
        tokens = [hashlib.blake2b(a + b, digest_size=16, salt=length.to_bytes(8, "big")).digest() for a, b in zip(tokens, tokens[length:], strict=False)]
        sums = [a + b for a, b in zip(sums, sums[length:], strict=False)]
        length *= 2
        yield from (t for t, n in zip(tokens, sums, strict=True) if n >= min_words)


def with_runs(shared: DataFrame, min_words: int) -> DataFrame:
    """ROWS and size: shared ROWS without repetitions and the runs of successive shared lines, with the number of such lines of the
    document."""
    ordered = shared.select("doc", "th", "at", "token", "words", "kind", "alone").repartition("doc", "th").sortWithinPartitions("doc", "th", "at", "kind", "token")
    names = ["doc", "th", "at", "token", "words", "kind", "alone", "size"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int8(), pa.bool_(), pa.int32())

    def document(doc: int, th: int, rows: list[tuple]) -> Iterator[tuple]:
        own = [r for r in rows if r[3] != RUN]
        for row in rows:
            yield (doc, th, *row, len(own))
        for token in set(ladder([r[1] for r in own], [r[2] for r in own], min_words)):
            yield doc, th, -1, token, 0, RUN, False, len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, done = None, [], []
        for batch in batches:
            for doc, th, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, th) != now:
                    if rows:
                        done += document(*now, rows)
                    now, rows = (doc, th), []
                if not rows or rows[-1] != tuple(row):  # a repeated row brings each token again
                    rows.append(tuple(row))
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if rows:
            done += document(*now, rows)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(run, ROWS + ", size int")


def find_matches(rows: DataFrame, min_words: int, tables: list[DataFrame]) -> DataFrame:
    """MATCHES of every pair of documents that is to be aligned, from ROWS."""
    # a token that very many documents hold makes a large join key; the adaptive skew join splits it
    several = settle(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "line-tokens")
    held = settle(with_runs(rows.join(several, "token"), min_words), "shared-lines")
    meeting = held.where(F.col("kind") != SHORT)
    first = meeting.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "size")).alias("first")).where("n > 1")
    first = settle(first.select("token", F.col("first.doc").alias("doc0"), F.col("first.th").alias("th0"), F.col("first.size").alias("size0")), "first-holders")
    other = (F.col("doc") != F.col("doc0")) | (F.col("th") != F.col("th0"))
    pairs = meeting.select("token", "doc", "th", "size").join(first, "token").where(other).select("doc", "th", "size", "doc0", "th0", "size0").distinct()

    # the lines of the document that has fewer are looked up in the other one, so a pair makes no more rows than the smaller has
    lines = held.where(F.col("kind") != RUN).select("doc", "th", "token", "at", "alone", "words")
    least = F.col("size0") < F.col("size")
    asked = pairs.select("doc", "th", "doc0", "th0", least.alias("swapped"))
    near = lambda a, b, c: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a)).alias(c)
    asked = asked.select("swapped", near("doc", "doc0", "a"), near("th", "th0", "ta"), near("doc0", "doc", "b"), near("th0", "th", "tb"))
    one = lines.select(F.col("doc").alias("a"), F.col("th").alias("ta"), "token", F.col("at").alias("pa"), F.col("alone").alias("la"), "words")
    two = lines.select(F.col("doc").alias("b"), F.col("th").alias("tb"), "token", F.col("at").alias("pb"), F.col("alone").alias("lb"))
    both = asked.join(one, ["a", "ta"]).join(two, ["b", "tb", "token"])
    tables += [several, held, first]
    named = [near("a", "b", "doc"), near("ta", "tb", "th"), near("b", "a", "doc0"), near("tb", "ta", "th0"), near("pa", "pb", "at"), near("pb", "pa", "at0")]
    return both.select(*named, (F.col("la") & F.col("lb")).alias("unique"), "words").select(*MATCHES)


def find_deletions(rows: DataFrame, min_words: int, moved_words: int, tables: list[DataFrame]) -> DataFrame:
    """(doc, th, places): the lines to delete from each later document."""
    ordered = find_matches(rows, min_words, tables).repartition("doc", "th").sortWithinPartitions("doc", "th", "doc0", "th0", "at", "at0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pair, matches, places = None, None, [], set()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            docs, ths, sets = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array([sorted(s) for s in sets], pa.list_(pa.int32()))], ["doc", "th", "places"])

        for batch in batches:
            for doc, th, doc0, th0, at, at0, unique, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, th, doc0, th0) != pair:
                    if matches:
                        places |= deleted_places(matches, min_words, moved_words)
                    pair, matches = (doc, th, doc0, th0), []
                    if (doc, th) != now:
                        if places:
                            done.append((*now, places))
                        now, places = (doc, th), set()
                matches.append((at, at0, unique, words))
            if len(done) > 1000:
                yield flush()
        if matches:
            places |= deleted_places(matches, min_words, moved_words)
        if places:
            done.append((*now, places))
        if done:
            yield flush()

    return ordered.mapInArrow(run, "doc long, th long, places array<int>")


def repeated_places(lines: list[str], places: set[int], moved_words: int) -> set[int]:
    """Places of the runs of lines that follow each other like deleted ones and have moved_words words."""
    first: dict[str, int] = {}
    for at in sorted(places):
        first.setdefault(lines[at], at)
    again = [(at, first[line]) for at, line in enumerate(lines) if at not in places and line in first]
    return {at for block in blocks(again) if sum(len(lines[at].split()) for at in block) >= moved_words for at in block}


def without(text: str, places: set[int], moved_words: int) -> tuple[str, int, int]:
    """The text without the lines at these places and their repetitions, the number of lines, and of deleted ones."""
    lines = kept_lines(text)
    if not places:
        return text, len(lines), 0
    drop = places | repeated_places(lines, places, moved_words)
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            if at not in drop:
                out.append(line)
            at += 1
        elif out:
            out.append(line)
    return "\n".join(out), len(lines), len(drop)


def dedup_lines(docs: DataFrame, min_words: int = 4, moved_words: int = 12) -> DataFrame:
    """docs with the deleted lines taken out of text, and n_lines and n_deleted, which count the lines that aren't blank."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows, tables = settle(lines_of(docs.where(F.col("text").isNotNull()).select(*document_keys(), "text"), min_words), "lines"), []
    places = settle(find_deletions(rows, min_words, moved_words, tables), "deleted-lines")
    discard(rows, *tables)
    row = F.struct(*names).alias("row")
    joined = docs.select(row, *document_keys()).join(places, ["doc", "th"], "left").select("row.*", F.col("places").alias("_places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts, counts, gone = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                left = (None, 0, 0) if text is None else without(text, set(places or ()), moved_words)
                for out, x in zip((texts, counts, gone), left, strict=True):
                    out.append(x)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(gone, pa.int32())], [*names, "n_lines", "n_deleted"])

    fields = [StructField("text", StringType()) if c == "text" else docs.schema[c] for c in names]
    return joined.mapInArrow(cut, StructType([*fields, StructField("n_lines", IntegerType()), StructField("n_deleted", IntegerType())]))
