"""Shared folder, file access and batch plumbing of the training-data operators."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.session import settle as materialize
from spindrift.session import shared_folder as shared_dir

__all__ = ["annotate", "by_hash", "chunks", "documents", "drawn", "get_bytes", "held", "keep_rows", "materialize", "open_fs", "put_bytes", "release", "shared_dir", "texts_of"]

#: Text bytes that one call of a batch function gets at most, unless one text alone is longer.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """File system and path of a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri:
        if not uri.startswith("file:"):
            return fs.LocalFileSystem(), uri
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, data: bytes) -> None:
    """Write under another name, then rename: readers see whole files only."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def get_bytes(uri: str) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_stream(path) as f:
        return f.read()


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What make() gives for a key. A worker, which serves one operator after another, keeps one such thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def texts_of(column: pa.Array) -> list:
    """UTF-8 bytes of a string column; None for null."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts, each of about `most` bytes; what they took goes back to the system at the end."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + most, "right"))))
            yield batch.slice(at, to - at), texts_of(column.slice(at, to - at))
            at = to
    pa.default_memory_pool().release_unused()


def annotate(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], fields: list[T.StructField], most: int = CHUNK_BYTES) -> DataFrame:
    """df and the columns that make()(texts) returns; those replace columns of df with the same name. A call gets about `most` bytes of texts."""
    new = {f.name.lower() for f in fields}
    keep = [f.name for f in df.schema.fields if f.name.lower() not in new]
    source = df if text in keep else df.withColumn("_annotate_text", df[text])
    column = text if text in keep else "_annotate_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch, texts in chunks(batches, column, most):
            columns = [batch.column(k) for k in keep] + [pa.array(v, type=t) for v, t in zip(fn(texts), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in fields)])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in fields]
    return source.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), *fields]))


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], most: int = CHUNK_BYTES) -> DataFrame:
    """The rows of df for which make()(texts) is true; no column is added, so that no name can clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch, texts in chunks(batches, text, most):
            yield batch.filter(pa.array(np.asarray(fn(texts), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of their keys.

    A threshold a half above the wanted share of the hashes goes first, so that no task hands over more than its part of them.
    """
    total = df.count()
    h = F.xxhash64(F.col(key).cast("string"))
    if total > 2 * most:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int(1.5 * most / total * (1 << 40)) + 1)
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), h, key).limit(most)


def drawn(text: Column, key: Column, pieces: int, size: int) -> Column:
    """At most pieces * size characters from all over a text, for a bounded sample.

    Of each of so many equal parts come `size` consecutive characters from a place that a hash of the key draws, or all of a part
    that has no more; so a text of up to pieces * size characters comes whole.
    """
    n, out = F.length(text), []
    for k in range(pieces):
        begin, end = F.floor(n * k / pieces), F.floor(n * (k + 1) / pieces)
        at = begin + F.pmod(F.xxhash64(key, F.lit(k)), F.greatest(end - begin - size, F.lit(0)) + 1) + 1
        out.append(F.substring(text, at.cast("int"), F.least(end - begin, F.lit(size)).cast("int")))
    return F.concat(*out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
