"""Text normalisation and similarity as column functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, with the four separators that Python counts too.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_case(c: Column) -> Column:
    return F.lower(c)


def strip_punctuation(c: Column) -> Column:
    """Drops what is neither a word character (underscore included) nor white space."""
    return F.regexp_replace(c, r"(?U)[^\w\s\x1c-\x1f]", "")


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        if v is None or v.isascii():
            return v
        return "".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x))

    return values.map(one)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; no built-in function does that, so an Arrow UDF."""
    return _fold(c)


def normalize_string(c: Column) -> Column:
    """Accents, case, punctuation, white space, in that order; null becomes the empty string."""
    return F.coalesce(normalize_whitespace(strip_punctuation(normalize_case(strip_accents(c)))), F.lit(""))


def tokens(c: Column) -> Column:
    """Words between white space, none for an empty string."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest common blocks; depends on the order of its arguments."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio cannot exceed, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


#: What counts as a number in a text column.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy")


def is_number(c: Column) -> Column:
    return c.cast("string").rlike(NUMBER)


def is_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in DATE_FORMATS)).isNotNull()
