"""General column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

#: The names of small numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty twenty-one twenty-two twenty-three twenty-four twenty-five"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Text without the white space (of any alphabet) around it; Spark's trim takes off spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def scan_map(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replaces each match of pattern by change(match): a regular-expression replacement with a callback.

    Matches are set off by a mark, at which the text is cut: every second part is a match.  A text without a match isn't
    cut.  The mark, U+0001, counts as a space where the text itself has it."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(F.translate(text, mark, " "), f"(?s){pattern}", f"{mark}$0{mark}"), mark)
    return F.when(text.rlike(f"(?s){pattern}"), F.array_join(F.transform(parts, lambda s, k: F.when(k % 2 == 1, change(s)).otherwise(s)), "")).otherwise(text)


def number_word(digits: Column) -> Column:
    """The name of a number from 0 to 25 given as digits; larger ones as digits without leading zeros."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    names = F.array(*map(F.lit, NUMBER_WORDS))
    small = F.when(F.length(plain) <= 2, F.try_element_at(names, F.expr("1").cast("int") + F.when(F.length(plain) <= 2, plain).cast("int")))
    return F.coalesce(small, plain)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bit_set(members: Column, alphabet: Sequence[str]) -> Column:
    """Members of an alphabet as an integer with one bit each; null stays null."""
    bits = (F.when(F.array_contains(members, c), 1 << k).otherwise(0) for k, c in enumerate(alphabet))
    return F.when(members.isNotNull(), sum(bits, F.lit(0)))


def bucket_of(salt: str, name: Column, buckets: int = 100) -> Column:
    """The first four bytes of SHA-256("salt:name") modulo buckets: the same bucket in every engine."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), name), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def run_lengths(items: Column, key: Callable[[Column], Column], merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """Merges neighbours of equal key in an array whose elements have the SQL type kind."""

    def step(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merge(last, item)))
        return F.when((F.size(done) > 0) & (key(last) == key(item)), joined).otherwise(F.concat(done, F.array(item)))

    return F.aggregate(items, F.array().cast(f"array<{kind}>"), step)
