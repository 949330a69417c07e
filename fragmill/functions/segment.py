"""Cutting a facet's text into fragments: lines, bullets, keyword lists, keyword expansion and overload."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .exprs import let, strip

#: Fixed values.
REMINDER = r"\s*\([^)]*\)"
KEYWORD_ARGUMENT = r"\s*(\{[^}]*\}|[—-]\s*.*|\d+)+$"
COST_RUN = r"(?:\{[^}]*\})+"
TARGET = r"(?i)\btarget\b"
SENTENCE_TARGET = r"(?i)(^|[.!?]\s+|\n)(target)\b"
BULLET = "•"


def without_reminder(line: Column) -> Column:
    return strip(F.regexp_replace(line, REMINDER, ""))


def no_stops(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+\z", "")


def is_keyword(part: Column, keywords: Iterable[str]) -> Column:
    """Whether a part is a keyword, a keyword with a cost or number, or one with an argument after "from"."""
    known = F.array(*(F.lit(k) for k in sorted(keywords))).cast("array<string>")
    word = F.lower(no_stops(strip(part)))
    bare = strip(F.regexp_replace(word, KEYWORD_ARGUMENT, ""))
    forms = F.array(word, bare, F.substring_index(word, " from ", 1))
    return (word != "") & F.arrays_overlap(forms, known)


def split_lines(text: Column, keywords: Iterable[str]) -> Column:
    """The fragments of a text in printed order: a bullet joins the fragment before it, a line of two or more keywords becomes
    one fragment each, and any other line stays whole."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")

    def step(done: Column, line: Column) -> Column:
        parts = F.filter(F.split(without_reminder(line), "[;,]"), lambda p: strip(p) != "")
        listed = (F.size(parts) > 1) & F.forall(parts, lambda p: is_keyword(p, keywords))
        attached = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit("\n"), line)))
        return (
            F.when(line.startswith(BULLET) & (F.size(done) > 0), attached)
            .when(listed, F.concat(done, F.transform(parts, lambda p: no_stops(strip(p)))))
            .otherwise(F.concat(done, F.array(line)))
        )

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def split_query(query: Column, keywords: Iterable[str]) -> Column:
    """A query's fragments: ``//`` separates lines, and the rest goes by the rules for texts."""
    return split_lines(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s*//\s*", "\n"), keywords)


def expanded(line: Column, templates: Mapping[str, str]) -> Column:
    """The head of a catalogued keyword with what it means, its first cost filled in; null for any other line."""
    head = strip(no_stops(without_reminder(line)))
    catalogue = F.create_map(*(F.lit(x) for pair in sorted(templates.items()) for x in pair)) if templates else F.create_map().cast("map<string,string>")
    template = F.try_element_at(catalogue, F.regexp_replace(head, COST_RUN, "{cost}"))
    cost = F.regexp_extract(head, COST_RUN, 0)
    meaning = F.when(cost != "", F.replace(template, F.lit("{cost}"), cost)).otherwise(template)
    return F.when(head != "", F.concat(head, F.lit(". "), meaning))


def sources(text: Column, keywords: Iterable[str], templates: Mapping[str, str]) -> Column:
    """array<struct<display, source>>: what is shown of each fragment and what is normalized.

    If one line starts with "overload" and exactly one other line has the word "target", a fragment with "each" in its place
    follows that line."""

    def build(lines: Column) -> Column:
        pairs = F.transform(lines, lambda x: F.struct(x.alias("display"), F.coalesce(expanded(x, templates), x).alias("source")))
        at = F.array_position(F.transform(lines, lambda x: F.lower(without_reminder(x)).startswith("overload")), F.lit(True))
        numbers = F.transform(lines, lambda x, i: F.when(x.rlike(TARGET) & (i + 1 != at), i + 1))
        targeted = F.filter(numbers, lambda i: i.isNotNull())

        def insert(k: Column) -> Column:
            base = without_reminder(F.try_element_at(lines, k))
            each = F.regexp_replace(F.regexp_replace(base, SENTENCE_TARGET, "$1Each"), TARGET, "each")
            extra = F.struct(F.concat(F.lit("Overloaded — "), each).alias("display"), each.alias("source"))
            return F.concat(F.slice(pairs, F.lit(1), k), F.array(extra), F.slice(pairs, k + 1, F.size(pairs)))

        return F.when((at > 0) & (F.size(targeted) == 1), insert(F.try_element_at(targeted, F.lit(1)).cast("int"))).otherwise(pairs)

    return let(split_lines(text, keywords), build)
