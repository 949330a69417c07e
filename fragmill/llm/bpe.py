"""Byte-pair encoding and decoding with segment trees.

The merges of a pre-token are found by a segment tree over its adjacent pairs.  A leaf holds rank * width + position of a
mergeable pair; every node holds its children's minimum, so the root yields the leftmost pair of lowest rank.  A merge
changes at most three leaves, each followed by one update per level, until no mergeable pair remains.  The trees of many
pre-tokens of like length are held as rows of one array and advance together.

Edge cases: a null text counts as empty and gives no ids and an empty decoding; the strings of special tokens in a text are
encoded as those tokens, as the tokenizer file says; repeated rows are encoded alike; a very long pre-token has a tree of
its own; other columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import by_bytes
from .token_memo import ChunkEncoder, after_space, byte_pieces, cut_byte_level

#: Fixed value: the pre-token pattern of byte-level tokenizers.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: Latin-1's printable characters stand for
    themselves, the others are moved behind U+00FF in order."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(keep)))}
    return [moved.get(b, chr(b)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocabulary[x] for x in letters], dtype=np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocabulary[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        keys, order = np.unique(left << 32 | right, return_index=True)
        self.keys, self.ranks = np.append(keys, NONE), np.append(order.astype(np.int64), NONE)
        self.rank_of = {(a, b): k for k, (a, b) in reversed(list(enumerate(zip(left.tolist(), right.tolist(), strict=True))))}
        self.merged = np.array([vocabulary["".join(m)] for m in merges], dtype=np.int64)
        back = {x: b for b, x in enumerate(letters)}
        self.token_bytes = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(map(back.__getitem__, token)) if all(x in back for x in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.pre_tokens = regex.compile(PRE_TOKENS).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where the pair isn't mergeable."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            if len(b) == 1:
                out[k] = self.byte_ids[[b[0]]].astype("<u4").tobytes()
            elif b:
                classes.setdefault(max(1, (len(b) - 2).bit_length()), []).append(k)
        for levels, members in classes.items():
            if levels > 8:  # few and long: plain lists are faster than arrays of one row
                for k in members:
                    out[k] = self._merge_long(raw[k], levels)
                continue
            step = max(1, (1 << 17) >> levels)
            for i in range(0, len(members), step):
                part = members[i : i + step]
                for k, ids in zip(part, self._merge([raw[k] for k in part], levels), strict=True):
                    out[k] = ids
        return out

    def _merge(self, words: list[bytes], levels: int) -> Iterator[bytes]:
        """Merges words of 2 to 2 ** levels + 1 bytes, each with a tree of 2 ** levels leaves."""
        width, n = 1 << levels, len(words)
        size = np.array([len(w) for w in words])
        position = np.arange(width + 2)
        inside = position[None, :] < size[:, None]
        symbol = np.full((n, width + 2), -1, dtype=np.int64)
        symbol[inside] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.where(inside, np.minimum(position + 1, width + 1), width + 1)
        before = np.broadcast_to(position - 1, symbol.shape).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = np.where(inside[:, 1 : width + 1], self.rank(symbol[:, :width], symbol[:, 1 : width + 1]), NONE)
        tree[:, width:] = np.where(rank < NONE, rank * width + position[:width], NONE)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = leaf + width
            tree[rows, node] = value
            for _ in range(levels):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(rows):
            lowest = tree[rows, 1]
            at, new = lowest & (width - 1), self.merged[lowest >> levels]
            gone = after[rows, at]
            follows = after[rows, gone]
            symbol[rows, at], symbol[rows, gone] = new, -1
            after[rows, at] = follows
            real = follows <= width
            real[real] = symbol[rows[real], follows[real]] >= 0
            before[rows[real], follows[real]] = at[real]
            has_pair = gone < width
            update(rows[has_pair], gone[has_pair], NONE)
            right = np.full(len(rows), NONE)
            right[real] = self._leaf(new[real], symbol[rows[real], follows[real]], at[real], width)
            update(rows, at, right)
            ahead = before[rows, at] >= 0
            prior, some = before[rows, at][ahead], rows[ahead]
            update(some, prior, self._leaf(symbol[some, prior], new[ahead], prior, width))
            rows = rows[tree[rows, 1] < NONE]
        kept = symbol >= 0
        data, ends = symbol[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        start = 0
        for end in ends.tolist():
            yield data[start:end]
            start = end

    def _merge_long(self, word: bytes, levels: int) -> bytes:
        """The same for one long word."""
        width, n = 1 << levels, len(word)
        symbol = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        first = self.rank(symbol[:-1], symbol[1:])
        leaves = np.full(width, NONE)
        leaves[: n - 1] = np.where(first < NONE, np.where(first < NONE, first, 0) * width + np.arange(n - 1), NONE)
        levels_up = [leaves]
        while len(levels_up[-1]) > 1:
            levels_up.append(np.minimum(levels_up[-1][::2], levels_up[-1][1::2]))
        tree, symbol = [NONE, *np.concatenate(levels_up[::-1]).tolist()], symbol.tolist()
        before, after, ranks = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank_of

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                low = left if left < right else right
                if tree[node] == low:
                    break
                tree[node] = low

        while (lowest := tree[1]) < NONE:
            at = lowest & (width - 1)
            new, gone = int(self.merged[lowest >> levels]), after[at]
            follows = after[gone]
            symbol[at], symbol[gone], after[at] = new, -1, follows
            if gone < width:
                update(gone, NONE)
            value = NONE
            if follows < n:
                before[follows] = at
                if (rank := ranks.get((new, symbol[follows]))) is not None:
                    value = rank * width + at
            update(at, value)
            if (prior := before[at]) >= 0:
                rank = ranks.get((symbol[prior], new))
                update(prior, NONE if rank is None else rank * width + prior)
        return np.array([x for x in symbol if x >= 0], dtype="<u4").tobytes()

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self.rank(left, right)
        return np.where(rank < NONE, np.where(rank < NONE, rank, 0) * width + at, NONE)

    def whole(self, chunk: str) -> bytes:
        """Encodes a chunk that may hold special tokens or any character."""
        out = []
        for k, part in enumerate(self.split_special(chunk)):
            out += [np.array([self.special[part]], dtype="<u4").tobytes()] if k % 2 else self.encode_pieces(self.pre_tokens(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def bpe_encoder(path: str) -> tuple[Bpe, ChunkEncoder]:
    """A worker's encoder; what pre-tokens encode to is remembered between batches, in a bounded memo."""
    bpe = Bpe(path)
    return bpe, ChunkEncoder(cut_byte_level, after_space, byte_pieces, bpe.encode_pieces, bpe.whole)


def encode_and_decode(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with keep_ids also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = bpe_encoder(tokenizer)
        for batch in by_bytes(batches, "text"):
            ids = encoder.encode(batch.column("text").to_pylist())
            decoded = list(map(bpe.decode, ids))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            if keep_ids:
                columns |= {"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
