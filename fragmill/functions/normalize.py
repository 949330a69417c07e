"""Normalization of rules text to plain words, as one native column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import collapse_spaces, let, number_word, run_lengths, scan_map, strip

#: Fixed values.
EMPTY = "emptyoracle"
SELF_REFERENCES = [
    ("creature", "this creature"),
    ("planeswalker", "this planeswalker"),
    ("land", "this land"),
    ("artifact", "this artifact"),
    ("enchantment", "this enchantment"),
    ("instant", "this spell"),
    ("sorcery", "this spell"),
]
BASIC_LANDS = "plains|island|swamp|mountain|forest"
COLORS = {"W": "white", "U": "blue", "B": "black", "R": "red", "G": "green"}
AROUND_NAME = r"[\s.,;:!?()\[\]\-]"
SYMBOL_RUN = r"(?:\{[a-zA-Z0-9/]+\})+"
STRENGTHS = r"([+-])?\s*(\d+|[XYZxyz])\s*/\s*([+-])?\s*(\d+|[XYZxyz])"
LOYALTY = r"([+-])\s*(\d+)\s*(:)?"

SYMBOL = "struct<key:string,phrase:string,countable:boolean,n:bigint>"


def self_reference(type_line: Column) -> Column:
    """How a text refers to its own entity: by the first of the primary types that it has."""
    primary = F.lower(F.substring_index(F.coalesce(type_line, F.lit("")), "—", 1))
    words = F.split(F.replace(primary, F.lit("//"), F.lit(" ")), r"(?U)\s+")
    out = F.lit("this card")
    for name, phrase in reversed(SELF_REFERENCES):
        out = F.when(F.array_contains(words, name), phrase).otherwise(out)
    return out


def reminders(text: Column, type_line: Column, keep: bool = False) -> Column:
    """Text in parentheses is dropped, or unwrapped if keep or on lands with a basic type."""
    kind = F.lower(strip(F.coalesce(type_line, F.lit(""))))
    unwrapped, dropped = F.regexp_replace(text, r"\(([^)]*)\)", " $1 "), F.regexp_replace(text, r"\([^)]*\)", " ")
    return unwrapped if keep else F.when(kind.contains("land") & kind.rlike(BASIC_LANDS), unwrapped).otherwise(dropped)


def own_name(text: Column, name: Column, phrase: Column) -> Column:
    """The entity's name, then the part before its first comma if longer than two characters, gives way to the phrase."""
    name = F.coalesce(name, F.lit(""))

    def gone(t: Column, n: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(n, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
        pattern = F.concat(F.lit(f"(?U)(^|{AROUND_NAME})"), quoted, F.lit(f"($|{AROUND_NAME})"))
        return F.when(n != "", F.regexp_replace(t, pattern, F.concat(F.lit("$1"), phrase, F.lit("$2")))).otherwise(t)

    short = F.when(name.contains(","), strip(F.substring_index(name, ",", 1))).otherwise("")
    short = F.when((F.length(short) > 2) & (short != name), short).otherwise("")
    return gone(gone(text, name), short)


def sentences(text: Column) -> Column:
    """Lines that aren't blank, each ended by a stop, in one line."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit(".")))), " ")


def _symbol(inner: Column, phrase: Column) -> Column:
    """What one symbol says, as SYMBOL; null if it is unknown."""

    def said(key: Column | str, words: Column | str, countable: bool, n: Column | int = 1) -> Column:
        as_column = [x if isinstance(x, Column) else F.lit(x) for x in (key, words, countable, n)]
        return F.struct(*(c.cast(t).alias(a) for c, a, t in zip(as_column, ("key", "phrase", "countable", "n"), ("string", "string", "boolean", "bigint"), strict=True)))

    s = F.upper(inner)
    colors = F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))
    half = lambda p: F.coalesce(
        F.try_element_at(colors, p), F.when(p.rlike(r"^\d+\z"), number_word(p)), F.when(p.isin("P", "PHYREXIAN"), "phyrexian"), F.lower(p)
    )
    return (
        F.when(s == "T", said("tap", F.concat(F.lit("tap "), phrase), True))
        .when(s == "Q", said("untap", F.concat(F.lit("untap "), phrase), True))
        .when(s.isin(*COLORS), said(F.concat(F.lit("mana_"), s), F.concat(F.try_element_at(colors, s), F.lit(" mana")), True))
        .when(s == "C", said("mana_C", "colorless mana", True))
        .when(s == "S", said("mana_S", "snow mana", True))
        .when(s == "E", said("energy", "energy counter", True))
        .when(s == "X", said("x", "x mana", False))
        .when(s.rlike(r"^\d+\z"), said("generic", "generic mana", True, F.when(s.rlike(r"^\d{1,18}\z"), s).cast("bigint")))
        .when(s.contains("/"), said("hybrid", F.concat(F.array_join(F.transform(F.split(s, "/+"), half), " or "), F.lit(" mana")), False))
    )


def symbol_words(run: Column, phrase: Column) -> Column:
    """A run of symbols in words: equal neighbours are added up, and the parts are joined by "and"."""
    parsed = F.filter(F.transform(F.regexp_extract_all(run, F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda s: _symbol(s, phrase)), lambda s: s.isNotNull())
    add = lambda a, b: F.struct(a["key"].alias("key"), a["phrase"].alias("phrase"), a["countable"].alias("countable"), (a["n"] + b["n"]).alias("n"))
    groups = run_lengths(parsed, lambda s: s["key"], add, SYMBOL)

    def words(g: Column) -> Column:
        n = number_word(g["n"].cast("string"))
        mana = (g["key"] == "generic") | g["key"].startswith("mana_")
        return (
            F.when((g["n"] == 1) & mana, F.concat(F.lit("one "), g["phrase"]))
            .when((g["n"] == 1) | ~g["countable"], g["phrase"])
            .when(g["key"] == "energy", F.concat(n, F.lit(" energy counters")))
            .when(mana, F.concat(n, F.lit(" "), g["phrase"]))
            .when(g["n"] == 2, F.concat(g["phrase"], F.lit(" twice")))
            .otherwise(F.concat(g["phrase"], F.lit(" "), n, F.lit(" times")))
        )

    # groups are computed once
    return let(groups, lambda found: F.when(F.size(found) > 0, F.concat(F.lit(" "), F.array_join(F.transform(found, words), " and "), F.lit(" "))).otherwise(" "))


def strength_words(match: Column) -> Column:
    """Strength and toughness in words; a part that is zero is left out, a letter stands for power."""

    def part(sign: int, value: int, noun: str) -> Column:
        prefix = F.when(F.regexp_extract(match, STRENGTHS, sign) == "+", "plus ").when(F.regexp_extract(match, STRENGTHS, sign) == "-", "minus ").otherwise("")
        v = F.regexp_extract(match, STRENGTHS, value)
        letter = F.concat(prefix, F.lower(v), F.lit(" power" if value == 2 else " toughness"))
        return F.when(v.rlike("^[a-zA-Z]"), letter).when(v.rlike("[1-9]"), F.concat(prefix, number_word(v), F.lit(f" {noun}")))

    parts = F.filter(F.array(part(1, 2, "strength"), part(3, 4, "toughness")), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " and "), F.lit(" "))).otherwise(" ")


def loyalty_words(match: Column) -> Column:
    digits = F.regexp_extract(match, LOYALTY, 2)
    return F.concat(
        F.when(match.startswith("+"), "add ").otherwise("remove "),
        number_word(digits),
        F.when(digits.rlike("^0*1$"), " loyalty counter").otherwise(" loyalty counters"),
        F.when(match.endswith(":"), " :").otherwise(""),
    )


def pay_costs(text: Column) -> Column:
    """Activation costs that mention mana begin with "pay", and commas in a cost become "and"."""

    def one(phrase: Column) -> Column:
        spaced, plain = F.instr(phrase, " :"), F.instr(phrase, ":")
        at = F.when(spaced > 0, spaced).otherwise(plain)
        cost = F.replace(strip(F.substring(phrase, F.lit(1), at - 1)), F.lit(","), F.lit(" and "))
        rest = F.substring(phrase, at, F.length(phrase))
        pays = F.lower(cost).contains("mana") & ~F.lower(cost).startswith("pay ")
        return strip(F.when(at == 0, phrase).otherwise(F.concat(F.when(pays, "pay ").otherwise(""), cost, rest)))

    return strip(F.array_join(F.filter(F.transform(F.split(text, r"(?U)\.\s+"), one), lambda x: x != ""), ". "))


def plain_characters(text: Column) -> Column:
    """Letters, digits and a few marks; apostrophes go, all else becomes a space."""
    return collapse_spaces(F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), r"[^a-zA-Z0-9\s.,/+\-:]", " "))


def punctuation(text: Column) -> Column:
    """No space before a mark, and no repeated marks."""
    closed = F.regexp_replace(text, r"\s+([.,/+\-:])", "$1")
    return collapse_spaces(F.regexp_replace(closed, r"([.,/+\-:])\s*\1+", "$1"))


def normalize(text: Column, name: Column, type_line: Column, keep_reminders: bool = False, phrase: Column | None = None) -> Column:
    """The whole pipeline; null, empty and vanished texts are EMPTY.  The phrase is the self-reference of the type line if not given."""
    phrase = self_reference(type_line) if phrase is None else phrase
    steps = [
        lambda t: reminders(t, type_line, keep_reminders),
        lambda t: own_name(t, name, phrase),
        sentences,
        lambda t: collapse_spaces(scan_map(t, SYMBOL_RUN, lambda run: symbol_words(run, phrase))),
        lambda t: scan_map(t, STRENGTHS, strength_words),
        lambda t: scan_map(t, LOYALTY, loyalty_words),
        pay_costs,
        lambda t: scan_map(t, r"\d+", number_word),
        plain_characters,
        punctuation,
    ]
    out = F.coalesce(text, F.lit(""))
    for step in steps:
        out = let(out, step)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(EMPTY))
