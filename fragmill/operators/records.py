"""Raw records to entities and facets: eligibility, the best record of each entity, and the derived columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.exprs import strip

#: Fixed values.
SKIPPED_LAYOUTS = ["art_series", "token", "double_faced_token", "emblem", "planar", "scheme", "vanguard"]
PAPER_FORMATS = ["standard", "pioneer", "modern", "legacy", "vintage", "commander", "pauper"]
TYPE_CATEGORIES = ["artifact", "creature", "enchantment", "instant", "land", "planeswalker", "sorcery"]
COLOR_ORDER = ["W", "U", "B", "R", "G"]
NO_DATE, NO_NUMBER = "9999-99-99", "zzzz"


def skipped(keep_null: bool = False) -> Column:
    """True for records that aren't paper game pieces; a null part of a rule counts as not fulfilled."""
    faces = F.coalesce(F.col("card_faces"), F.array())

    def any_part(field: str, test) -> Column:  # noqa: ANN001
        return F.coalesce(test(F.col(field)), F.lit(False)) | F.exists(faces, lambda f: F.coalesce(test(f[field]), F.lit(False)))

    legal = F.exists(F.array(*map(F.lit, PAPER_FORMATS)), lambda f: F.coalesce(F.try_element_at(F.col("legalities"), f).isin("legal", "restricted", "banned"), F.lit(False)))
    rules = [
        F.col("layout").isin(SKIPPED_LAYOUTS),
        F.col("games").isNotNull() & ~F.array_contains("games", "paper") & ~F.coalesce(legal, F.lit(False)),
        any_part("name", lambda c: strip(c).startswith("A-")),
        F.col("arena_id").isNotNull() & (F.coalesce(F.size("multiverse_ids"), F.lit(0)) <= 0) & F.coalesce("mtgo_id", "tcgplayer_id", "cardmarket_id").isNull(),
        any_part("type_line", lambda c: strip(c) == "Card"),
    ]
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def eligible(records: DataFrame) -> DataFrame:
    return records.where((F.coalesce(F.col("oracle_id"), F.lit("")) != "") & ~skipped())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The winner of each run of rows of an entity: a later record replaces the present one if its number is lower, as numbers if
    both are, else as texts.  One row of the entity at hand is held, across batches too."""
    best: pa.RecordBatch | None = None
    key = number = text = None
    for batch in batches:
        winners: list[int] = []
        held = -1  # the place of the best record in this batch, if it is here
        for place, (k, n, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("oracle_id", "_n", "_number")), strict=True)):
            if best is None and held < 0 or k != key:
                if held >= 0:
                    winners.append(held)
                elif best is not None:
                    yield best.select(["oracle_id", "_order"])
                best = None
                key, number, text, held = k, n, t, place
            elif n < number if n is not None and number is not None else t < text:
                number, text, held, best = n, t, place, None
        if winners:
            yield batch.take(pa.array(winners)).select(["oracle_id", "_order"])
        if held >= 0:
            best = batch.take(pa.array([held]))  # a copy, so that the batch can go
    if best is not None:
        yield best.select(["oracle_id", "_order"])


def best_records(records: DataFrame, order: str = "ordinal") -> DataFrame:
    """The best record of each oracle_id, by a fold in the order of the input: paper, then the earlier date, then the lower number.

    Numbers are compared as numbers where both are, else as texts, which is no total order, so a plain minimum would be wrong.
    Paper and date are one, so a combined minimum leaves only the records that agree in both; those go in order through a
    fold that holds one of them, whatever an entity has.  Only keys are shuffled for it; order has to be unique and the same in
    every scan."""
    paper, date = F.coalesce(F.array_contains("games", "paper"), F.lit(False)), F.coalesce(F.nullif("released_at", F.lit("")), F.lit(NO_DATE))
    number = F.coalesce(F.nullif("collector_number", F.lit("")), F.lit(NO_NUMBER))
    whole = F.regexp_replace(number, r"(?<=\d)_(?=\d)", "").try_cast("bigint")
    keyed = records.select("oracle_id", F.col(order).alias("_order"), F.struct((~paper).alias("late"), date.alias("date")).alias("_class"), number.alias("_number"), whole.alias("_n"))
    first = keyed.groupBy("oracle_id").agg(F.min("_class").alias("_class"))
    rows = keyed.join(first, ["oracle_id", "_class"]).select("oracle_id", "_order", "_number", "_n")
    kind = StructType([StructField("oracle_id", rows.schema["oracle_id"].dataType), StructField("_order", rows.schema["_order"].dataType)])
    winners = rows.repartition("oracle_id").sortWithinPartitions("oracle_id", "_order").mapInArrow(_fold, kind)
    best = records.join(winners.select("oracle_id", F.col("_order").alias(order)), ["oracle_id", order], "left_semi")
    return best.drop(order)


def type_categories(type_line: Column) -> Column:
    """The known types left of the dash, sorted."""
    words = F.split(F.lower(strip(F.substring_index(F.coalesce(type_line, F.lit("")), "—", 1))), r"(?U)\s+")
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, TYPE_CATEGORIES))))


def color_identity(colors: Column) -> Column:
    """Colours in their fixed order."""
    return F.array_join(F.filter(F.array(*map(F.lit, COLOR_ORDER)), lambda c: F.coalesce(F.array_contains(colors, c), F.lit(False))), "")


def entities(best: DataFrame) -> DataFrame:
    return best.select(
        F.col("oracle_id").alias("entity_id"), F.col("id").alias("record_id"), "name", "layout", F.col("cmc").cast("double").alias("cmc"), F.col("edhrec_rank").alias("rank"),
        "rarity", "legalities", F.col("set").alias("set_code"), "border_color", color_identity(F.col("color_identity")).alias("identity"), "keywords",
    )


def facets(best: DataFrame) -> DataFrame:
    """One row per face; a record without faces is its own face."""
    names = ["name", "mana_cost", "type_line", "oracle_text", "power", "toughness", "loyalty", "defense", "colors"]
    own = F.array(F.struct(*(F.col(c).alias(c) for c in names)))
    faces = F.transform("card_faces", lambda f: F.struct(*(f[c].alias(c) for c in names)))
    parts = best.select(F.col("oracle_id").alias("entity_id"), F.posexplode(F.when(F.size("card_faces") > 0, faces).otherwise(own)).alias("facet_ix", "f"))
    return parts.select("entity_id", "facet_ix", "f.*").withColumnRenamed("oracle_text", "text").withColumn("categories", type_categories(F.col("type_line")))
