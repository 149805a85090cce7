"""Profiles, validation, cleaning and quality of any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import is_date, is_number, normalize_whitespace

WEIGHTS = {"completeness": 0.40, "uniqueness": 0.25, "validity": 0.20, "consistency": 0.15}


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number in a floating column."""
    c = df[name]
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def _sum(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (f.cast("long") for f in flags), F.lit(0).cast("long"))


def _kinds(df: DataFrame, figures: dict[str, Column], over: list[str] | None = None) -> DataFrame:
    """One row: `rows`, `kinds` (rows that differ in the columns `over`, or in any) and the sums of some figures.

    Rows are told apart by a 128-bit digest, so that only digests and partial sums are shuffled, however wide the table is. Each value goes in
    with a mark for null, as hashes skip nulls.
    """
    fields = [df.schema[c] for c in over or df.columns]
    cells = [x for f in fields for x in (F.to_json(df[f.name]) if isinstance(f.dataType, T.MapType) else df[f.name], df[f.name].isNull())]
    digest = [F.xxhash64(F.lit(k), *cells).alias(f"_d{k}") for k in (1, 2)]
    groups = df.select(*digest, *(c.alias(n) for n, c in figures.items())).groupBy("_d1", "_d2").agg(F.count("*").alias("_n"), *(F.sum(n).alias(n) for n in figures))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("kinds"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in figures))


def summarize(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count, columns, dtypes, missing_value_pct, duplicate_row_count, duplicate_row_pct."""
    k = len(df.columns)
    cells = _kinds(df, {"gaps": _sum([missing(df, c) for c in df.columns])})
    total = F.greatest(F.col("rows") * k, F.lit(1))
    twice = F.col("rows") - F.col("kinds")
    return cells.select(
        F.col("rows").alias("row_count"), F.lit(k).cast("long").alias("column_count"), F.array(*map(F.lit, df.columns)).cast("array<string>").alias("columns"), F.array(*(F.lit(t) for _, t in df.dtypes)).cast("array<string>").alias("dtypes"),
        F.round(100 * F.col("gaps") / total, 2).alias("missing_value_pct"), twice.alias("duplicate_row_count"),
        F.when(F.col("rows") == 0, 0.0).otherwise(F.round(100 * twice / F.greatest(F.col("rows"), F.lit(1)), 2)).alias("duplicate_row_pct"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """column_name, missing_count: one aggregation of all columns, turned to rows."""
    counts = df.agg(*(F.coalesce(F.sum(missing(df, c).cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("missing_count")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")


def preview(df: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    """The first rows by an ordering key, as tables have no order of their own."""
    return df.orderBy(*order).limit(rows)


def clean(df: DataFrame, drop_duplicates: bool = True, strip_whitespace: bool = True) -> DataFrame:
    """Normalises white space in text columns, then drops repeated rows; columns stay as they are."""
    if strip_whitespace:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.select(*(normalize_whitespace(df[c]).alias(c) if c in texts else df[c] for c in df.columns))
    return df.dropDuplicates() if drop_duplicates else df


def clean_report(df: DataFrame, drop_duplicates: bool = True, strip_whitespace: bool = True) -> DataFrame:
    """original_row_count, cleaned_row_count, duplicate_rows_removed, whitespace_normalized_cells."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if strip_whitespace else []
    changed = _sum([F.coalesce(normalize_whitespace(df[c]) != df[c], F.lit(False)) for c in texts])
    cells = df.select(*(normalize_whitespace(df[c]).alias(c) if c in texts else df[c] for c in df.columns), changed.alias("_changed"))
    out = _kinds(cells, {"whitespace_normalized_cells": cells["_changed"]}, df.columns).withColumnRenamed("rows", "original_row_count")
    kept = F.col("kinds") if drop_duplicates else F.col("original_row_count")
    return out.select("original_row_count", kept.alias("cleaned_row_count"), (F.col("original_row_count") - kept).alias("duplicate_rows_removed"), "whitespace_normalized_cells")


def _invalid(df: DataFrame, column: str, rule: str) -> Column:
    ok = is_number(df[column]) if rule == "numeric" else is_date(df[column])
    return ~missing(df, column) & ~ok


def _rules(df: DataFrame, rules: dict[str, str] | None) -> dict[str, str]:
    return {c: r for c, r in (rules or {}).items() if c in df.columns and r in ("numeric", "date")}


def invalid_values(df: DataFrame, rules: dict[str, str] | None) -> DataFrame:
    """column_name, checked, invalid_count for rules `numeric` and `date`; absent columns and other rules are skipped."""
    known = _rules(df, rules)
    if not known:
        return df.sparkSession.createDataFrame([], "column_name string, checked long, invalid_count long")
    aggs = []
    for i, (c, r) in enumerate(known.items()):
        aggs += [F.coalesce(F.sum((~missing(df, c)).cast("long")), F.lit(0)).alias(f"n{i}"), F.coalesce(F.sum(_invalid(df, c, r).cast("long")), F.lit(0)).alias(f"x{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("checked"), F.col(f"x{i}").alias("invalid_count")) for i, c in enumerate(known)))
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def validate_schema(df: DataFrame, required: list[str] | None = None) -> tuple[bool, list[str], list[str]]:
    """Whether the table is usable, what speaks against it, and the required columns that it lacks."""
    issues = []
    if not df.columns or df.isEmpty():
        issues.append("the table is empty")
    if not df.columns:
        issues.append("the table has no column")
    absent = [c for c in required or [] if c not in df.columns]
    if absent:
        issues.append(f"required columns are absent: {', '.join(absent)}")
    return not issues, issues, absent


def validate(df: DataFrame, required: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """One row: is_valid (of the schema alone), issues, missing_required_columns, invalid_value_count, invalid_value_pct."""
    valid, issues, absent = validate_schema(df, required)
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    totals = invalid_values(df, rules).agg(F.coalesce(F.sum("invalid_count"), F.lit(0)).alias("x"), F.coalesce(F.sum("checked"), F.lit(0)).alias("n"))
    found = F.when(F.col("x") > 0, F.array(F.format_string("%d values are not of the type that a rule asks for", "x"))).otherwise(strings([]))
    return totals.select(F.lit(valid).alias("is_valid"), F.concat(strings(issues), found).alias("issues"), strings(absent).alias("missing_required_columns"), F.col("x").alias("invalid_value_count"), F.round(100 * F.col("x") / F.greatest("n", F.lit(1)), 2).alias("invalid_value_pct"))


def quality(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency, overall_score (0 to 100) and explanation."""
    known, k = _rules(df, rules), len(df.columns)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    figures = {"gaps": _sum([missing(df, c) for c in df.columns])}
    for i, c in enumerate(texts):
        figures |= {f"t{i}": df[c].isNotNull(), f"m{i}": F.coalesce(is_number(df[c]), F.lit(False))}
    for i, (c, r) in enumerate(known.items()):
        figures |= {f"v{i}": ~missing(df, c), f"x{i}": _invalid(df, c, r)}
    one = _kinds(df, {n: c.cast("long") for n, c in figures.items()})
    cells = F.col("rows") * k
    mixed = _sum([(F.col(f"m{i}") > 0) & (F.col(f"m{i}") < F.col(f"t{i}")) for i in range(len(texts))])
    checked, invalid = _sum([F.col(f"v{i}") for i in range(len(known))]), _sum([F.col(f"x{i}") for i in range(len(known))])
    parts = one.select(
        F.when(cells == 0, 1.0).otherwise(1 - F.col("gaps") / F.greatest(cells, F.lit(1))).alias("completeness"),
        F.when(F.col("rows") == 0, 1.0).otherwise(1 - (F.col("rows") - F.col("kinds")) / F.greatest(F.col("rows"), F.lit(1))).alias("uniqueness"),
        (1 - invalid / F.greatest(checked, F.lit(1))).alias("validity"),
        (1 - mixed / max(k, 1)).alias("consistency"),
    )
    overall = reduce(lambda a, b: a + b, (F.col(m) * w for m, w in WEIGHTS.items())) * 100
    says = {"completeness": "cells with a value", "uniqueness": "rows that repeat no other", "validity": "checked values of the right type", "consistency": "columns that do not mix numbers with other text"}
    lines = [F.format_string(f"{m}, {says[m]}: %.1f of 100, counts {w:.2f}", F.col(m) * 100) for m, w in WEIGHTS.items()]
    return parts.select(*(F.round(F.col(m) * 100, 2).alias(m) for m in WEIGHTS), F.round(overall, 2).alias("overall_score"), F.array(*lines).alias("explanation"))
