"""Request filters: validation on the driver, and one predicate on facets, put below the scoring."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

#: Fixed values.
COLORS = "WUBRG"
MAX_QUERY_FRAGMENTS, MAX_QUERY_CHARS, MAX_OFFSET, MAX_LIMIT, MAX_CODES, MAX_SELECTION = 6, 200, 500, 100, 16, 64


def color_mask(letters: Iterable[str]) -> int:
    """Bits of the known colours; other letters, also the one for colourless, count for nothing."""
    return sum(1 << COLORS.index(c) for c in set(letters) if c in COLORS)


def color_filter(have: Column, wanted: int, mode: str) -> Column:
    """Null never matches; no wanted colour filters nothing."""
    if mode not in ("at_least", "at_most", "exact"):
        raise ValueError(f"unknown match mode {mode!r}")
    if not wanted:
        return F.lit(True)
    found = {"at_least": have.bitwiseAND(wanted) == wanted, "at_most": have.bitwiseAND(31 ^ wanted) == 0, "exact": have == wanted}[mode]
    return F.coalesce(found, F.lit(False))


def any_category(categories: Column, wanted: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, wanted))), F.lit(False))


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """Null is out of any range with a bound."""
    bounds = [c for c in (None if low is None else value >= low, None if high is None else value <= high) if c is not None]
    return F.coalesce(reduce(and_, bounds), F.lit(False)) if bounds else F.lit(True)


def any_format(legalities: Column, formats: Iterable[str]) -> Column:
    wanted = F.array(*map(F.lit, formats))
    return F.coalesce(F.exists(wanted, lambda f: F.coalesce(F.try_element_at(legalities, f).isin("legal", "restricted"), F.lit(False))), F.lit(False))


@dataclass
class Filters:
    """All filters of a request over facet columns categories, identity_mask, color_mask, cmc, legalities and rarity."""

    categories: tuple[str, ...] = ()
    colors: str = ""
    color_feature: str = "identity"
    color_mode: str = "at_least"
    cmc_min: float | None = None
    cmc_max: float | None = None
    formats: tuple[str, ...] = ()
    rarities: tuple[str, ...] = ()

    def predicate(self) -> Column:
        parts = [color_filter(F.col("identity_mask" if self.color_feature == "identity" else "color_mask"), color_mask(self.colors), self.color_mode), in_range(F.col("cmc"), self.cmc_min, self.cmc_max)]
        if self.categories:
            parts.append(any_category(F.col("categories"), self.categories))
        if self.formats:
            parts.append(any_format(F.col("legalities"), self.formats))
        if self.rarities:
            parts.append(F.coalesce("rarity", F.lit("")).isin(*self.rarities))
        return reduce(and_, parts)


def decode_codes(codes: str, table: Mapping[str, str], what: str) -> list[str]:
    """One letter per value; unknown and repeated letters are errors."""
    bad = [c for c in codes if c not in table]
    if bad:
        raise ValueError(f"unknown {what} code {bad[0]!r}")
    if len(set(codes)) != len(codes):
        raise ValueError(f"repeated {what} code")
    if len(codes) > MAX_CODES:
        raise ValueError(f"too many {what} codes")
    return [table[c] for c in codes]


def encode_codes(values: Iterable[str], table: Mapping[str, str]) -> str:
    """The letters of known values, each once."""
    letters = {value: code for code, value in table.items()}
    return "".join(dict.fromkeys(letters[v] for v in values if v in letters))


def fragment_numbers(text: str) -> list[int]:
    """Comma-separated fragment numbers, sorted and distinct."""
    try:
        numbers = sorted({int(x) for x in text.split(",") if x.strip()})
    except ValueError:
        raise ValueError("fragment numbers must be integers") from None
    if numbers and numbers[0] < 0 or len(numbers) > MAX_SELECTION:
        raise ValueError("fragment numbers must be at least 0, and not too many")
    return numbers


def check_request(query: str | None, entity_id: str | None, limit: int = 20, offset: int = 0, n_fragments: int = 0) -> None:
    """Raises ValueError for a request out of bounds."""
    if not entity_id and not (query or "").strip():
        raise ValueError("a request needs an entity or a query")
    if len(query or "") > MAX_QUERY_CHARS:
        raise ValueError("the query is too long")
    if not 1 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise ValueError("limit or offset is out of bounds")
    if n_fragments > MAX_QUERY_FRAGMENTS:
        raise ValueError(f"a query has at most {MAX_QUERY_FRAGMENTS} fragments")
