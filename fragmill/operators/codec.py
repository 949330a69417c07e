"""Requests as url queries in a canonical form, column by column, and back.

Values that aren't known are dropped, repeated ones counted once, defaults left out and keys sorted, so that a request has one
form; reading that form gives the normalized request again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..functions.exprs import let
from .serve import CATEGORY_CODES, FORMAT_CODES, RARITY_CODES

#: Fixed values, the keys in the order of the canonical form.
KEYS = {"entity_id": "card", "cmc_max": "cmcMax", "cmc_min": "cmcMin", "color_feature": "colorBy", "colors": "colors", "exclude": "exc", "facet_ix": "face", "formats": "format", "include": "inc", "color_mode": "match", "query": "q", "rarities": "rarity", "categories": "type"}
MODES, FEATURES = ("at_least", "at_most", "exact"), ("identity", "colors")  # the first is the default
#: The type of a request.
REQUEST = "struct<query: string, entity_id: string, facet_ix: int, include: array<int>, exclude: array<int>, categories: array<string>, formats: array<string>, rarities: array<string>, colors: string, color_mode: string, color_feature: string, cmc_min: double, cmc_max: double>"


def _known(values: Column, options: Sequence[str]) -> Column:
    """Trimmed values that are options, each once, in their order; null if none is."""
    found = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isin(*options)))
    return F.when(F.size(found) > 0, found)


def _not_default(value: Column, options: Sequence[str]) -> Column:
    return F.when(value.isin(*options[1:]), value)


def _numbers(values: Column) -> Column:
    """Places from 0 on, sorted and each once; null if there is none."""
    found = F.array_sort(F.array_distinct(F.filter(values, lambda v: v >= 0)))
    return F.when(F.size(found) > 0, found)


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalized(request: Column) -> Column:
    """A request with what is unknown, repeated or a default taken out; an entity wins over a query, and an included place over an
    excluded one."""
    return let(request, _normalized)


def _normalized(request: Column) -> Column:
    entity = F.nullif(F.trim(request["entity_id"]), F.lit(""))
    query = F.when(entity.isNull(), F.nullif(F.trim(request["query"]), F.lit("")))
    include = F.when(entity.isNotNull(), _numbers(request["include"]))
    exclude = F.when(entity.isNotNull(), _numbers(F.array_except(request["exclude"], F.coalesce(include, F.array().cast("array<int>")))))
    out = {
        "query": query, "entity_id": entity, "facet_ix": F.when(entity.isNotNull() & (request["facet_ix"] > 0), request["facet_ix"]), "include": include, "exclude": exclude,
        "categories": _known(request["categories"], list(CATEGORY_CODES.values())), "formats": _known(request["formats"], list(FORMAT_CODES.values())),
        "rarities": F.array_sort(_known(request["rarities"], list(RARITY_CODES.values()))), "colors": F.nullif(request["colors"], F.lit("")),
        "color_mode": _not_default(request["color_mode"], MODES), "color_feature": _not_default(request["color_feature"], FEATURES),
        "cmc_min": _finite(request["cmc_min"]), "cmc_max": _finite(request["cmc_max"]),
    }
    return F.struct(*(c.alias(n) for n, c in out.items())).cast(REQUEST)


def _number_text(value: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _letters(values: Column, codes: Mapping[str, str]) -> Column:
    letter = F.create_map(*(F.lit(x) for code, value in codes.items() for x in (value, code)))
    return F.array_join(F.transform(values, lambda v: letter[v]), "")


def encoded(request: Column) -> Column:
    """The url query of a request, without the question mark."""
    return let(normalized(request), _encoded)


def _encoded(r: Column) -> Column:
    text = {n: r[n] for n in ("query", "entity_id", "colors", "color_mode", "color_feature")}
    text |= {"facet_ix": r["facet_ix"].cast("string"), "cmc_min": _number_text(r["cmc_min"]), "cmc_max": _number_text(r["cmc_max"])}
    text |= {"categories": _letters(r["categories"], CATEGORY_CODES), "formats": _letters(r["formats"], FORMAT_CODES), "rarities": F.array_join(r["rarities"], ",")}
    text |= {n: F.array_join(r[n].cast("array<string>"), ",") for n in ("include", "exclude")}
    return F.concat_ws("&", *(F.concat(F.lit(f"{key}="), F.url_encode(text[name])) for name, key in KEYS.items()))


def decoded(url_query: Column) -> Column:
    """The normalized request of a url query; unknown keys and values are dropped."""
    pairs = F.transform(F.split(url_query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, F.try_url_decode(F.regexp_extract(p, "(?s)=(.*)$", 1))).otherwise("").alias("value")))
    return let(let(pairs, _request), _normalized)


def _request(pairs: Column) -> Column:
    """What the keys of a query say, as it stands."""

    def value(name: str) -> Column:
        return F.try_element_at(F.transform(F.filter(pairs, lambda p: p["key"] == KEYS[name]), lambda p: p["value"]), F.lit(1))

    def values(name: str, codes: Mapping[str, str]) -> Column:
        names = F.create_map(*(F.lit(x) for item in codes.items() for x in item))
        return F.transform(F.split(value(name), ""), lambda c: F.try_element_at(names, c))

    def places(name: str) -> Column:
        return F.transform(F.split(value(name), ","), lambda c: F.trim(c).try_cast("int"))

    return F.struct(
        value("query").alias("query"), value("entity_id").alias("entity_id"), value("facet_ix").try_cast("int").alias("facet_ix"), places("include").alias("include"), places("exclude").alias("exclude"),
        values("categories", CATEGORY_CODES).alias("categories"), values("formats", FORMAT_CODES).alias("formats"), F.split(value("rarities"), ",").alias("rarities"), value("colors").alias("colors"),
        value("color_mode").alias("color_mode"), value("color_feature").alias("color_feature"), value("cmc_min").try_cast("double").alias("cmc_min"), value("cmc_max").try_cast("double").alias("cmc_max"),
    )
