"""File sources: CSV, JSON and XLSX with one way of inferring types, and a registry by suffix."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import NUMBER
from spindrift.operators.profile import summarize

# What a cell says when it has no value.
NO_VALUE = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: Bytes from which a file is worth splitting.
SPLIT_BYTES = 64 << 20


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place))


def _need(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(path)


def infer(df: DataFrame) -> DataFrame:
    """Text columns to long, double or boolean where all values allow it; dates stay text. One aggregation decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    value = {c: F.when(df[c].isin(*NO_VALUE), None).otherwise(df[c]) for c in texts}
    tests = []
    for i, c in enumerate(texts):
        v = value[c]
        whole = v.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        tests += [F.count(v).alias(f"n{i}"), F.count(F.when(whole, 1)).alias(f"w{i}"), F.count(F.when(v.rlike(NUMBER), 1)).alias(f"d{i}"), F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{i}")]
    got, out = df.agg(*tests).first(), {}
    for i, c in enumerate(texts):
        n, v = got[f"n{i}"], value[c]
        kind = "string" if not n else "long" if got[f"w{i}"] == n else "double" if got[f"d{i}"] == n else "boolean" if got[f"b{i}"] == n else "string"
        out[c] = v if kind == "string" else F.trim(v).cast(kind)
    return df.select(*(out[c].alias(c) if c in out else df[c] for c in df.columns))


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for top in files.globStatus(place) for s in (files.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return max((s.getLen() for s in found if s.isFile()), default=0)


def quoted_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a cell of a CSV file may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def load_csv(spark: SparkSession, path: str, strings: bool = False) -> DataFrame:
    """A CSV file with a header; `strings` keeps all cells as text, empty ones as null.

    A file whose cells hold line breaks is read by one task, as only its beginning tells where rows begin. Files larger than SPLIT_BYTES are
    looked through for such cells first, and split where there are none; smaller ones are one task's work anyway.
    """
    _need(spark, path)
    whole = largest_file(spark, path) <= SPLIT_BYTES or quoted_line_breaks(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=whole, escape='"')
    return df if strings else infer(df)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or an object with them under `records`; each file is one JSON value, and so one task's work."""
    _need(spark, path)
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["records"] and isinstance(df.schema["records"].dataType, T.ArrayType):
        return df.select(F.explode("records").alias("r")).select("r.*")
    return df


def load_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    from spindrift.sources.xlsx import XlsxSource

    _need(spark, path)
    spark.dataSource.register(XlsxSource)
    return infer(spark.read.format("xlsx").option("path", path).option("sheet", str(sheet)).load())


def load_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first sheets of workbooks with one header, as one table; types are inferred over all of them."""
    from spindrift.sources.xlsx import XlsxSource

    spark.dataSource.register(XlsxSource)
    out = None
    for path in paths:
        _need(spark, path)
        one = spark.read.format("xlsx").option("path", path).option("sheet", "0").load()
        out = one if out is None else out.unionByName(one)
    return infer(out)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    _need(spark, path)
    return spark.read.parquet(path)


READERS = {".csv": load_csv, ".json": load_json, ".xlsx": load_excel, ".parquet": load_parquet}


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix."""
    suffix = "." + path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix!r}; known: {', '.join(READERS)}")
    return READERS[suffix](spark, path)


def load_with_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The table and its summary, with the seconds that reading and counting took."""
    start = time.perf_counter()
    df = load(spark, path)
    summary = summarize(df)
    row = summary.first()
    return df, spark.createDataFrame([row], summary.schema).withColumn("load_time_seconds", F.lit(time.perf_counter() - start))


def to_date(c: Column) -> Column:
    """A date, null for an empty cell; garbage is an error."""
    return F.nullif(F.trim(c), F.lit("")).cast("date")


def to_time(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).cast("timestamp")


def to_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_number(c: Column, default: float | None = None) -> Column:
    """A number, or the default for an empty cell; garbage is an error."""
    own = F.nullif(F.trim(c), F.lit("")).cast("double")
    return own if default is None else F.coalesce(own, F.lit(default))
