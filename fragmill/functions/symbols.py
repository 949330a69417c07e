"""Cost symbols in a text: which are known, and the text cut at them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
SINGLE, NAMED, HALVES, LARGEST = "wubrgcsxyztqeap", ("paw", "infinity", "1/2", "acorn", "tk", "100"), "wubrg2p", 20

_NUMBER = "|".join([r"0?\d", *(str(k) for k in range(10, LARGEST + 1))])
_PART = f"[{SINGLE}2]"
#: Two digits are a number, so they aren't two halves.
_KNOWN = rf"(?i)^\{{(?:[{SINGLE}]|{'|'.join(NAMED)}|{_NUMBER}|{_PART}(?:/{_PART}){{1,2}}|(?!\d\d\}})[{HALVES}]{{2,3}})\}}$"


def is_known_symbol(symbol: Column) -> Column:
    """Whether a text is one known symbol in braces: a letter, a name, a number up to 20, or a hybrid of two or three parts."""
    return F.coalesce(symbol.rlike(_KNOWN), F.lit(False))


def symbol_parts(text: Column) -> Column:
    """The text cut before and after everything in braces, without empty parts."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(F.translate(text, mark, " "), r"\{[^}]*\}", f"{mark}$0{mark}"), mark)
    return F.filter(parts, lambda p: p != "")
