"""Encoding of many texts with few calls: texts are cut where the pre-tokenizer always cuts, and what a cut piece encodes to
is remembered in a bounded memo.

A chunk is a run that no token can cross the ends of; a piece is one pre-token of a plain chunk.  Chunks that hold anything
unusual (special tokens, letters outside Latin-1, rare white space) go to the encoder as they are.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens of a byte-level tokenizer in chunks of plain characters.
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Pre-tokens of the lower-casing word tokenizer in chunks of plain characters, after lower-casing.
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Chunks that the two patterns above cut as the tokenizers do.
PLAIN_BYTE, PLAIN_WORD = re.compile(r"[\n -~À-ÿ]*"), re.compile(r"[!-~À-ÿ]*")
PLAIN_TEXT, MARKS = re.compile(r"[\t\n\r !-&(-~À-ÿ]*"), re.compile(r"[^\sa-zß-öø-ÿ0-9]+")
NO_SPACE, RUNS, SPACE_MARK = "\x01", re.compile(r"[^ A-Za-z0-9À-ÖØ-öø-ÿ]+"), re.compile(r" (?:[^A-Za-z0-9À-ÖØ-öø-ÿ]|\Z)")
SPACE_RUN, SEPARATORS = re.compile(r" \s"), re.compile("[\x1c-\x1f]")


class Memo:
    """A dictionary of about 2 * limit entries: when the young half is full it becomes the old half."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, keys: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known of the keys, and the keys that aren't."""
        young, old, found, missing = self.young, self.old, {}, []
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    missing.append(key)
                    continue
                young[key] = value
            found[key] = value
        return found, missing

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that aren't known; those that are known are in the young half afterwards.  For many keys, mostly young ones."""
        absent = keys.difference(self.young)
        old = absent.intersection(self.old)
        self.young.update({key: self.old[key] for key in old})
        return list(absent.difference(old))

    def keep(self, new: dict[str, bytes]) -> None:
        """Remembers new entries; long keys aren't kept."""
        self.young.update(new if max(map(len, new), default=0) <= LONG else {k: v for k, v in new.items() if len(k) <= LONG})
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young


#: Keys of more characters aren't remembered.
LONG = 200


class ChunkEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    cut(text) -> (first chunk, other chunks); text_of(chunk) is the text that one of the others stands for.
    pieces(chunk) -> its pre-tokens, or None if the chunk must be encoded whole, by whole(chunk).
    encode_pieces(pieces) -> the ids of each, as bytes.
    """

    def __init__(self, cut: Callable, text_of: Callable, pieces: Callable, encode_pieces: Callable, whole: Callable, limit: int = 500_000):
        self.cut, self.text_of, self.pieces, self.encode_pieces, self.whole = cut, text_of, pieces, encode_pieces, whole
        self.after, self.first, self.parts = Memo(limit), Memo(limit // 8), Memo(limit // 4)

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        known = self._known(self.after, set().union(*(rest for _, rest in cuts)), self.text_of)
        first = self._known(self.first, {f for f, _ in cuts}, str)
        return [b"".join([first[f], *map(known.__getitem__, rest)]) for f, rest in cuts]

    def _known(self, memo: Memo, chunks: set[str], text_of: Callable) -> dict[str, bytes]:
        """The ids of the chunks, among others."""
        missing, young = memo.missing(chunks), memo.young
        if not missing:
            return young
        new, cuts, several, alone = {}, {}, set(), {}
        for c in missing:
            pieces = self.pieces(text_of(c))
            if pieces is None:
                new[c] = self.whole(text_of(c))
            elif len(pieces) == 1:
                alone[c] = pieces[0]  # such a chunk is remembered as a chunk only
            else:
                cuts[c] = pieces
                several.update(pieces)
        parts, unknown = self.parts.find(several)
        wanted = list(dict.fromkeys([*unknown, *alone.values()]))
        found = dict(zip(wanted, self.encode_pieces(wanted) if wanted else (), strict=True))
        self.parts.keep({p: found[p] for p in unknown})
        parts |= found
        new |= {c: parts[p] for c, p in alone.items()}
        new |= {c: b"".join(map(parts.__getitem__, pieces)) for c, pieces in cuts.items()}
        memo.keep(new)
        # keeping may make the young half the old one, which still holds all chunks but long ones
        return young if max(map(len, new)) <= LONG else {c: young[c] if c in young else new[c] for c in chunks}


def cut_byte_level(text: str) -> tuple[str, list[str]]:
    """Cuts before single spaces.  In a text with longer white space the first chunk is the whole text.

    A text of plain characters is also cut around runs of marks and line ends, which no pre-token crosses if nothing in it
    could join them: no apostrophe, no mark after a space, no empty line.  A chunk that doesn't follow a space begins with NO_SPACE."""
    if PLAIN_BYTE.fullmatch(text) and "'" not in text and "<|" not in text and "\n\n" not in text and not SPACE_MARK.search(text):
        first, *rest = RUNS.sub(f" {NO_SPACE}\\g<0> {NO_SPACE}", text).split(" ")
        return first, rest
    if NO_SPACE in text or SPACE_RUN.search(text):
        return text, []
    first, *rest = text.split(" ")
    return first, rest


def after_space(chunk: str) -> str:
    """The text of a byte-level chunk that isn't the first."""
    return chunk[1:] if chunk[:1] == NO_SPACE else " " + chunk


def byte_pieces(chunk: str) -> list[str] | None:
    """Pre-tokens of a byte-level chunk, or None where the chunk is not plain."""
    return BYTE_PIECES.findall(chunk) if "<|" not in chunk and PLAIN_BYTE.fullmatch(chunk) else None


def cut_words(text: str) -> tuple[str, list[str]]:
    """Cuts at white space, which the word tokenizer drops; the separators U+001C to U+001F aren't white space to it.

    In a text of plain characters without apostrophes, which begin contractions, letter case and what stands beside runs of
    marks don't matter, so it is lower-cased and cut around those runs too."""
    if PLAIN_TEXT.fullmatch(text) and "<|" not in text:
        return "", MARKS.sub(r" \g<0> ", text.lower()).split()
    return (text, []) if SEPARATORS.search(text) else ("", text.split())


def word_pieces(chunk: str) -> list[str] | None:
    """Pre-tokens of a word chunk, or None where the chunk is not plain."""
    return WORD_PIECES.findall(chunk.lower()) if "<|" not in chunk and PLAIN_WORD.fullmatch(chunk) else None


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=4)
def byte_level_library(path: str) -> ChunkEncoder:
    """Encoder with the tokenizers library for a byte-level BPE file without post-processing."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    newline = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<u4")

    def whole(chunk: str) -> bytes:
        return _packed(tokenizer.encode(chunk, add_special_tokens=False).ids)

    def many(pieces: list[str]) -> list[bytes]:
        """Pieces without line ends are encoded on a line each: a line end before a pre-token is a pre-token of its own."""
        plain = [p for p in pieces if not p.isspace()] if len(newline) == 1 else []
        out = {}
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            ids = np.frombuffer(whole("\n".join(part)), dtype="<u4")
            ends = np.flatnonzero(ids == newline[0])
            if len(ends) == len(part) - 1:
                bounds = [-1, *ends.tolist(), len(ids)]
                data = ids.tobytes()
                out.update((p, data[4 * (a + 1) : 4 * b]) for p, a, b in zip(part, bounds, bounds[1:], strict=False))
        return [out[p] if p in out else whole(p) for p in pieces]

    return ChunkEncoder(cut_byte_level, after_space, byte_pieces, many, whole)


@functools.lru_cache(maxsize=4)
def word_library(path: str) -> ChunkEncoder:
    """Encoder with the tokenizers library for a lower-casing word BPE file whose tokens mark the word's end by ``</w>``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = tokenizer.get_vocab()
    ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        ends_word[i] = token.endswith("</w>")

    def whole(chunk: str) -> bytes:
        return _packed(tokenizer.encode(chunk, add_special_tokens=False).ids)

    def many(pieces: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces), 1000):
            part = pieces[k : k + 1000]
            data = whole(" ".join(part))
            ends = np.flatnonzero(ends_word[np.frombuffer(data, dtype="<u4")])
            if len(ends) == len(part) and 4 * (ends[-1] + 1) == len(data):
                bounds = [0, *((ends + 1) * 4).tolist()]
                out += [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            else:
                out += map(whole, part)
        return out

    return ChunkEncoder(cut_words, str, word_pieces, many, whole)


def forget() -> None:
    """Frees the encoders and what they remember, which a reused worker would hold while it does other work."""
    byte_level_library.cache_clear()
    word_library.cache_clear()
