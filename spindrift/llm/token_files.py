"""Token ids as Arrow files: equal-length sequences and masks that are read in place.

A part file (Arrow IPC file format) holds record batches of SEQUENCES rows each (the last one may have fewer) with two
fixed-size lists of LENGTH elements: `ids` (uint16 where the vocabulary allows, else uint32) and `mask` (bits; false only
in the padding after the last document). Sequence i lies in batch i // SEQUENCES, row i % SEQUENCES; a memory-mapped file
gives it without a copy. The documents of a part follow each other in ascending doc_id order, each ended by END. Beside it
lies an Arrow file of the documents' bounds: doc_id, start in the part, number of ids. An index (Parquet) says in which file
and at which row of its bounds each document is. All files lie below the shared folder. A file's name is new with each
attempt of a task, and the index, written by Spark, names the files of the attempts that counted.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.pieces import BYTE_CHARS, Pieces, word_splitter
from spindrift.llm.shared import chunks, documents, held, open_fs, shared_dir

LENGTH = 2048
SEQUENCES = 256
END = 0
#: Rows of a batch of bounds.
BOUNDS = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library's ids of whole texts, as little-endian bytes; repeated words are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        kind = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.model = self.library.model
        self.pieces = Pieces(self.of_words, self.direct, b"".join, word_splitter(self.library) if self.cuts else None, self.specials, most_words=500_000)

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The library's model alone, as the words are cut already."""
        tokenize, kind = self.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes() for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(b"".join, self.pieces.parts(texts)))


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


class PartWriter:
    """Appends documents' ids to one part file, and their bounds to another; holds one record batch of each."""

    def __init__(self, uri: str, dtype: np.dtype, key: pa.DataType, end: int = END, length: int = LENGTH, sequences: int = SEQUENCES):
        files, path = open_fs(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.bounds_out = files.open_output_stream(path), files.open_output_stream(bounds_of(path))
        self.dtype, self.length, self.sequences = dtype, length, sequences
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"end": str(end)})
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.bounds_schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.bounds_file = pa.ipc.new_file(self.bounds_out, self.bounds_schema)
        self.held, self.size, self.written = [], 0, 0
        self.bounds, self.documents = [], 0

    def append(self, doc_id, ids: bytes) -> int:
        """The document's row among the bounds."""
        start = self.written + self.size
        n = len(ids) // self.dtype.itemsize
        self.bounds.append((doc_id, start, n))
        self.documents += 1
        if len(self.bounds) >= BOUNDS:
            self._write_bounds()
        self.held.append(ids)
        self.size += n
        if self.size >= (full := self.length * self.sequences):
            all_ids = np.frombuffer(b"".join(self.held), self.dtype)
            whole = self.size // full * full
            for at in range(0, whole, full):
                self._write(all_ids[at : at + full], full)
            self.held, self.size = [all_ids[whole:].tobytes()], self.size - whole
            self.written += whole
        return self.documents - 1

    def _write_bounds(self) -> None:
        columns = zip(*self.bounds, strict=True) if self.bounds else ((), (), ())
        self.bounds_file.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.bounds_schema, strict=True)], schema=self.bounds_schema))
        self.bounds = []

    def _write(self, ids: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < n)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.frombuffer(b"".join(self.held), self.dtype)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self._write_bounds()
        for part in (self.file, self.out, self.bounds_file, self.bounds_out):
            part.close()


def bounds_of(uri: str) -> str:
    """The file of the bounds that belongs to a part file."""
    return f"{uri.removesuffix('.arrow')}.bounds.arrow"


def _open(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A memory map where the file system is local."""
    from pyarrow import fs

    files, path = open_fs(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path))


class PartReader:
    """Random access to a part file; where the file system is local, views of a memory map."""

    def __init__(self, uri: str):
        self.file, self.bounds = _open(uri), _open(bounds_of(uri)).read_all()
        self.end = int(self.file.schema.metadata[b"end"])
        self.length = self.file.schema.field("ids").type.list_size
        self.batches: dict[int, np.ndarray] = {}
        self.sequences = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _ids(self, k: int) -> np.ndarray:
        if k not in self.batches:
            if len(self.batches) > 8:
                self.batches.clear()
            self.batches[k] = self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.batches[k]

    def sequence(self, i: int) -> np.ndarray:
        at = i % self.sequences * self.length
        return self._ids(i // self.sequences)[at : at + self.length]

    def mask(self, i: int) -> pa.Array:
        return self.file.get_batch(i // self.sequences).column("mask").slice(i % self.sequences, 1).flatten()

    def check(self) -> None:
        """An error unless the mask holds true for all ids of the documents and for nothing else."""
        full = sum(self.file.get_batch(k).column("mask").flatten().true_count for k in range(self.file.num_record_batches))
        last = self.bounds.num_rows - 1
        if full != (self.bounds["start"][last].as_py() + self.bounds["n_tokens"][last].as_py() if last >= 0 else 0):
            raise ValueError("the mask and the documents' bounds do not agree")

    def document(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the document at a row of the bounds, in views."""
        return self.span(self.bounds["start"][row].as_py(), self.bounds["n_tokens"][row].as_py())

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        full = self.length * self.sequences
        while n > 0:
            k, at = divmod(start, full)
            part = self._ids(k)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, length: int = LENGTH, sequences: int = SEQUENCES, partitions: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the index: doc_id, part, file, row (among the file's bounds), n_tokens.

    Null and empty texts give the end id alone. Equal doc_ids follow each other, ordered by text; null ids come first.
    An empty table gives an empty index and no file. Other columns of docs are not kept.
    """
    path = vocabulary or default_vocabulary()
    folder = shared_dir(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("part", T.LongType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        tool = encoder(path)
        part = TaskContext.get().partitionId()
        uri, writer = f"{folder}/ids/part-{part:06d}-{uuid.uuid4().hex}.arrow", None
        mark = np.array([end], tool.dtype).tobytes()
        for batch, texts in chunks(batches, "text", 8 << 20):
            writer = writer or PartWriter(uri, tool.dtype, batch.schema.field("doc_id").type, end, length, sequences)
            ids = [x + mark for x in tool.encode([t.decode("utf-8", "replace") if t else "" for t in texts])]
            rows = [writer.append(k, x) for k, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([part] * len(ids), pa.int64()), pa.array([uri] * len(ids)), pa.array(rows, pa.int64()), pa.array([len(x) // tool.dtype.itemsize for x in ids], pa.int64())], names=schema.names)
        if writer:
            writer.close()

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = (source.repartitionByRange(partitions, "doc_id") if partitions else source.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def read_token_files(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the Arrow files' contents.

    Only where to look, and how many ids the files before hold, comes from the index. A document that does not end with the end id, or a mask
    that does not fit, is an error.
    """
    sizes = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    bases = sizes.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = index.join(bases, "file").select("file", "row", "base")
    schema = T.StructType([index.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        readers: dict[str, PartReader] = {}
        for batch in batches:
            by_file: dict[str, list[int]] = {}
            for i, file in enumerate(batch.column("file").to_pylist()):
                by_file.setdefault(file, []).append(i)
            for file, own in by_file.items():
                if file not in readers:
                    if len(readers) > 64:
                        readers.clear()
                    readers[file] = PartReader(file)
                    readers[file].check()
                part, rows, sums = readers[file], batch.column("row").take(pa.array(own)), []
                for row in rows.to_pylist():
                    crc, last = 0, None
                    for ids in part.document(row):
                        crc, last = zlib.crc32(ids.astype("<u4").tobytes(), crc), ids[-1]
                    if last != part.end:
                        raise ValueError(f"a document of {file} does not end with id {part.end}")
                    sums.append(crc)
                bounds = part.bounds.take(rows).combine_chunks()
                base = batch.column("base")[own[0]].as_py()
                start = pa.array(bounds["start"].to_numpy() + base)
                yield pa.RecordBatch.from_arrays([bounds["doc_id"].combine_chunks(), start, bounds["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())], names=schema.names)

    return placed.mapInArrow(run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(documents(spark, sf_dir)))


QUERIES = {"op1_token_files": op1_token_files}
ORACLE: dict[str, str] = {}
