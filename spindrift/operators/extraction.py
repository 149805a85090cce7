"""Mentions of dates and proper nouns in text."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import normalize_whitespace

# Month names, and words that are capitalised for beginning a sentence.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
LEADING = ("the", "a", "an", "this", "that", "these", "those", "it", "he", "she", "they", "we", "i", "in", "on", "at", "after", "before", "during")
DATE = rf"\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\.?,?\s*\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b"
CAPITALISED = r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b"
# Labels that a model's mentions are kept for.
MODEL_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "NORP", "FAC")
METHODS = ("baseline", "spacy")

MENTION = T.ArrayType(T.StructType([T.StructField("entity_text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))
_DATE, _CAPITALISED, _SPACE = re.compile(DATE), re.compile(CAPITALISED), re.compile(r"\s+")


def clean_text(c: Column) -> Column:
    return normalize_whitespace(c)


def split_sentences(c: Column) -> Column:
    """Parts between white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def mentions_in(text: str | None) -> list[tuple[str, str, int, int]]:
    """Dates first, then capitalised sequences that no date overlaps; places are those in the text with single spaces."""
    clean = _SPACE.sub(" ", text).strip() if text else ""
    dates = [(m.group(), "DATE", m.start(), m.end()) for m in _DATE.finditer(clean)]
    nouns = [(m.group(), "PROPER_NOUN", m.start(), m.end()) for m in _CAPITALISED.finditer(clean)]
    free = [n for n in nouns if len(n[0]) > 1 and n[0].lower() not in LEADING and all(n[2] >= d[3] or n[3] <= d[2] for d in dates)]
    return dates + free


@F.pandas_udf(MENTION)
def _mentions(texts: pd.Series) -> pd.Series:
    return texts.map(mentions_in)


def extract(df: DataFrame, text: str = "text", method: str = "baseline", model: Callable[[str], list[tuple[str, str, int, int]]] | None = None) -> DataFrame:
    """df with `mention` columns, one row for each mention: entity_text, label, start_char, end_char, method.

    `spacy` needs the library with its English model, or a `model` of one's own; without both it is an error.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if method == "baseline":
        found = _mentions(F.col(text))
    else:
        found = _model_mentions(model or load_model())(F.col(text))
    rows = df.withColumn("_m", F.explode(found))
    return rows.select(*df.columns, "_m.*", F.lit(method).alias("method"))


def model_available() -> bool:
    return importlib.util.find_spec("spacy") is not None and importlib.util.find_spec("en_core_web_sm") is not None


def load_model() -> Callable[[str], list[tuple[str, str, int, int]]]:
    if not model_available():
        raise RuntimeError("the named-entity model is not installed; use method='baseline' or pass a model")
    held: list = []

    def run(text: str) -> list[tuple[str, str, int, int]]:
        if not held:
            import spacy

            held.append(spacy.load("en_core_web_sm"))
        return [(e.text, e.label_, e.start_char, e.end_char) for e in held[0](text).ents]

    return run


def _model_mentions(model):
    @F.pandas_udf(MENTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [m for m in model(_SPACE.sub(" ", t).strip()) if m[1] in MODEL_LABELS] if t and t.strip() else [])

    return run


def extract_for_texts(texts: DataFrame, source_id: str, text: str, method: str = "baseline", max_texts: int | None = None, model=None) -> DataFrame:
    """source_id, entity_text, label, method of the first max_texts texts by source_id; texts without mentions give no row."""
    own = texts.select(F.col(source_id).alias("source_id"), F.col(text).alias("text"))
    own = own.orderBy("source_id").limit(max_texts) if max_texts is not None else own
    return extract(own, "text", method, model).select("source_id", "entity_text", "label", "method")
