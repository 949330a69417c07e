"""Tokens, tag anchors and generated-query lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .exprs import strip

#: Words without content.
STOP_WORDS = """a an the of to and or is are was be been it its this that these those them they he she his her you your my
our their as at by for from in into on onto with without than then so if but not no nor do does did have has
had will would can could may might must shall should there here who whom which what when where why how all any
both each few more most other some such only own same too very""".split()


def content_tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Distinct tokens of a text that aren't stop words or single characters; all tokens if that leaves none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    # array_except is compiled, keeps the order and leaves one of each
    kept = F.array_except(F.regexp_extract_all(lower, F.lit("[a-z0-9']{2,}"), F.lit(0)), F.lit(list(stop_words)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9']+"), F.lit(0))))


def spaced(tag: Column) -> Column:
    return F.trim(F.translate(tag, "-_", "  "))


def tag_anchors(tag: Column, description: Column) -> Column:
    """A tag's texts: its name, and its name with its description."""
    name = spaced(tag)
    described = F.when(F.coalesce(description, F.lit("")) != "", strip(F.concat(name, F.lit(". "), description))).otherwise(name)
    return F.filter(F.array_distinct(F.array(name, described)), lambda a: a != "")


def query_lines(raw: Column, most: int = 5, max_chars: int = 80) -> Column:
    """Short queries from a model's answer: no thinking, no list marks, no closing marks, two to eight words, distinct."""
    answer = F.regexp_replace(raw, "(?si)<think>.*?</think>", "")
    lines = F.transform(F.split(answer, r"\r\n|[\n\r]"), lambda x: F.lower(F.regexp_replace(strip(F.regexp_replace(x, r"^[\s\-*•\d.)]+", "")), r"[.,;:]+\z", "")))
    words = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: words(x).between(2, 8) & (F.length(x) <= max_chars))), 1, most)
