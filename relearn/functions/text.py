"""Text folding shared by the rules.

Spark has no Unicode normalisation, so NFKC and case folding need Python. On text made only
of ASCII and common CJK ideographs the foldings below equal plain ``lower`` plus a character
filter, so such rows stay in the JVM and reach the Python worker as nulls.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip() set, as a regular-expression class.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SAID = f"[^{BLANK[1:]}"
PLAIN = r"^[\x{00}-\x{7f}\x{4e00}-\x{9fff}]*$"
PLAIN_CASE = (
    r"^[\x{00}-\x{1b}\x{20}-\x{7f}\x{3001}-\x{303f}\x{4e00}-\x{9fff}"
    r"\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff20}\x{2018}-\x{201d}]*$"
)

# kind -> (case rule, kept first letters of the Unicode category, drop combining marks)
FOLDS = {
    "evidence": (str.lower, "LN", False),
    "answer": (str.casefold, "LMN", False),
    "identity": (str.casefold, "LN", False),
    "toneless": (str.lower, "LN", True),
}


def strip(col: Column) -> Column:
    # Goes to the end and back over the blanks there; searching for blanks at an end would try every place of a long text.
    return F.regexp_extract(col, rf"(?s)\A{BLANK}*+(.*{SAID})", 1)


def is_blank(col: Column) -> Column:
    return F.coalesce(~col.rlike(SAID), F.lit(True))


def fold_one(value: str, kind: str) -> str:
    case, kept, toneless = FOLDS[kind]
    text = case(unicodedata.normalize("NFKC", value))
    if toneless:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(c for c in text if unicodedata.category(c)[0] in kept)


def _fold_udf(kind: str):
    @F.pandas_udf(T.StringType())
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fold_one(v, kind))

    return fold


def folded(col: Column, kind: str) -> Column:
    """Comparison form of a text; missing text folds to ''."""
    plain = F.coalesce(col.rlike(PLAIN), F.lit(True))
    native = F.regexp_replace(F.lower(col), r"[^a-z0-9\x{4e00}-\x{9fff}]", "")
    foreign = _fold_udf(kind)(F.when(~plain, col))
    return F.coalesce(F.when(plain, native).otherwise(foreign), F.lit(""))


@F.pandas_udf(T.StringType())
def _casefold_words(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(v.casefold().split()))


def casefold_words(col: Column) -> Column:
    """Case-folded text with runs of white space collapsed to one space."""
    plain = F.coalesce(col.rlike(PLAIN_CASE), F.lit(True))
    native = F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))
    return F.when(plain, native).otherwise(_casefold_words(F.when(~plain, col)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """SequenceMatcher ratio of two folded texts; 0 when either is empty."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)],
        dtype="float64",
    )
