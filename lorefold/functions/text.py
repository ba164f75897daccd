"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def normalise(text: pd.Series) -> pd.Series:
    """NFC, any run of white space as one blank, no white space at the ends; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def normalise_name(name: Column) -> Column:
    """Lower case with single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised names; 1 if equal, 0 if either is empty."""
    return text_similarity(normalise_name(a), normalise_name(b))


def text_similarity(x: Column, y: Column) -> Column:
    """``name_similarity`` of names that are normalised already."""
    return (
        F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
    )


def is_filled(text: Column) -> Column:
    """Whether a text is more than white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s+", "")) > 0, F.lit(False))


def note_of(field: Column, value: Column) -> Column:
    """``field: value``; a missing value is written ``null``."""
    return F.concat(field, F.lit(": "), F.coalesce(value, F.lit("null")))


def _plain_letters() -> dict[str, str]:
    """Every letter of the basic plane that is one letter with marks, and that letter."""
    out = {}
    for cp in range(0xC0, 0x10000):
        base = [c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(cp) and chr(cp).isalpha():
            out[chr(cp)] = base[0]
    return out


_PLAIN = _plain_letters()
_FROM, _TO = "".join(_PLAIN), "".join(_PLAIN.values())
_TABLE = str.maketrans(_PLAIN)


def fold_letters(text: str) -> str:
    """Lower case without accents: what ``folded`` makes of a column."""
    return re.sub("[\u0300-\u036f]+", "", text.lower().translate(_TABLE))


def folded(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or follow it."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), "[\u0300-\u036f]+", "")


def tokens(text: Column) -> Column:
    """Lower-case letter and number runs without accents, in order."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")


# Words that ordinary prose capitalises without naming anyone.
CAPITALISED = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october "
    "november december today tomorrow yesterday"
).split()


def proper_name_runs(prose: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Runs of capitalised words of three letters or more that don't begin a sentence, each run whole and once.

    The first capital of the text, and one after ``. ! ? :`` or a line end, is
    taken away, so a name at the start of a sentence loses its first word only.
    A run is left out if all its words are calendar words or ``ignored``.
    """
    inner = F.regexp_replace(prose, r"(^|[.!?:\n]\s*)[A-Z]", "$1")
    runs = F.regexp_extract_all(inner, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*(?![A-Za-z0-9_])"), 0)
    plain = F.array(*map(F.lit, (*CAPITALISED, *(w.lower() for w in ignored))))
    return F.array_distinct(F.filter(runs, lambda r: F.size(F.array_except(F.split(F.lower(r), r"\s+"), plain)) > 0))
