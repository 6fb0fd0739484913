"""JVM-side text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character class of white space of any kind: the Unicode property and the four separators
#: U+001C..U+001F that Python's ``str.split`` also takes as white space.
WS_CLASS = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{WS_CLASS}+|{WS_CLASS}+$"
_RUNS = rf"(?U){WS_CLASS}+"


def strip_ws(c: Column) -> Column:
    """Remove white space of any kind (no-break and typographic spaces too) at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def collapse_ws(c: Column) -> Column:
    """Strip, and turn every inner run of white space into one space."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def blank_to_null(c: Column) -> Column:
    """Null for a string without any visible character."""
    return F.when(strip_ws(c) != "", c)


#: The six domains a label can stand for; anything else counts as ``oos``. (Fixed values.)
DOMAINS = ("house", "utilizer", "okc", "payments", "boltalka", "oos")


def canonical_domain(c: Column) -> Column:
    """The domain a label spells: stripped and lower-cased; unknown, empty and null give ``oos``."""
    label = F.lower(strip_ws(c))
    return F.when(label.isin(*DOMAINS), label).otherwise(F.lit("oos"))
