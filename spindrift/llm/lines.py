"""Line dedup by overlapping windows of three lines.

Each document's lines are hashed; a window is three consecutive lines. Of each window that occurs several times anywhere
(by its 128-bit digest) the first occurrence, in order of doc_id and line, stays; a line inside a later occurrence goes.
As the text of each line that goes stands earlier too, what remains holds every line's text at least once.

A document is a doc_id with a text: rows that differ in either are different documents (of one doc_id, in the order of a hash
of their texts), and rows that agree in both are one. Ids of any type that has an order will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import chunks, documents, materialize

WINDOW = 3


def lines_of(text: bytes | None) -> list[bytes]:
    """Lines end at \\n; a null text has none, an empty one a single empty line."""
    return [] if text is None else text.split(b"\n")


def window_digests(lines: list[bytes], window: int = WINDOW) -> np.ndarray:
    """A 128-bit digest of each window as two signed longs; windows of blank lines alone are none and get zeros."""
    n = len(lines) - window + 1
    if n <= 0:
        return np.zeros((0, 2), np.int64)
    digest = xxhash.xxh3_128_digest
    own = [digest(x) for x in lines]
    blank = [not x.strip() for x in lines]
    both = [b"\0" * 16 if all(blank[i : i + window]) else digest(b"".join(own[i : i + window])) for i in range(n)]
    return np.frombuffer(b"".join(both), "<i8").reshape(n, 2)


def _hash(text: str):
    """What tells texts with one doc_id apart, beside the id."""
    return F.xxhash64(F.col(text))


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, th (a hash of the text), line (where the window begins) and the digest h1, h2 of each window."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("th", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            found = [window_digests(lines_of(t), window) for t in texts]
            counts = np.array([len(x) for x in found], np.int64)
            if not counts.sum():
                continue
            line = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
            both = np.concatenate(found)
            there = np.flatnonzero(both.any(1))
            owner = pa.array(np.repeat(np.arange(len(texts)), counts)[there])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("th").take(owner), pa.array(line[there]), pa.array(np.ascontiguousarray(both[there, 0])), pa.array(np.ascontiguousarray(both[there, 1]))], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), _hash(text).alias("th"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, th and starts: where later occurrences of repeated windows begin in a document."""
    found = materialize(windows(docs, doc_id, text, window), "windows")
    # written first: a join straight above an aggregation could not have its hot partitions split
    first = materialize(found.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "line")).alias("first")).where("c > 1").drop("c"), "first")
    later = found.join(first, ["h1", "h2"]).where(F.struct("doc_id", "th", "line") != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set("line").alias("starts"))


def covered(n: int, starts: list[int], window: int = WINDOW) -> np.ndarray:
    """Which of n lines lie in a window that begins at one of the starts."""
    edge, at = np.zeros(n + 1, np.int64), np.array(starts, np.int64)
    np.add.at(edge, np.minimum(at, n), 1)
    np.add.at(edge, np.minimum(at + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without the lines that later occurrences of a window cover; a document may be left with an empty text, but stays.

    Texts of under three lines, null and empty ones, and rows without a doc_id stay as they are; so do windows of blank lines
    alone. Rows with one doc_id and one text are one document and change alike; of one doc_id with several texts each is a document
    of its own. An empty table gives an empty result. With `counts`, two columns of these names have the lines of the input and
    those removed.
    """
    marks = later_lines(docs, doc_id, text, window).select(F.col("doc_id").alias("_line_id"), F.col("th").alias("_line_hash"), F.col("starts").alias("_line_starts"))
    joined = docs.join(marks.hint("shuffle_hash"), (docs[doc_id] == marks["_line_id"]) & (F.xxhash64(docs[text]) == marks["_line_hash"]), "left")
    keep = [c for c in docs.columns if not counts or c.lower() not in {x.lower() for x in counts}]
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in counts or ()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            kept, n_lines, gone = [], [], []
            for t, starts in zip(texts, batch.column("_line_starts").to_pylist(), strict=True):
                lines = lines_of(t)
                n_lines.append(len(lines))
                if not starts:
                    kept.append(t)
                    gone.append(0)
                    continue
                hit = covered(len(lines), starts, window)
                gone.append(int(hit.sum()))
                kept.append(b"\n".join(x for x, h in zip(lines, hit.tolist(), strict=True) if not h))
            columns = [pa.array(kept, pa.binary()).cast(batch.schema.field(text).type) if c == text else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64())] if counts else []), names=[f.name for f in fields])

    needed = joined.select(*(docs[c] for c in dict.fromkeys([*keep, text])), "_line_starts")
    return needed.mapInArrow(run, T.StructType(fields))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), wins AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM wins
  WHERE c IS NOT NULL AND regexp_replace(a || b || c, '[ \t\r\v\f]', '', 'g') <> ''
), gone AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM ranked, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS hit FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
