"""Substring dedup with compressed FM-indexes.

Repeats of WINDOW words are sought. Each window is known by the smallest hash of its GRAM-word runs, so that equal windows
have equal hashes, and consecutive windows with the same run make a segment. A hash that one segment alone has can hold no
repeat. Segments with one hash meet in a shard: the different ones, and of equal ones (by digest) the first and the last
occurrence, each with the words of its own document. The shard builds an FM-index of them and gets each one's matching
statistics, words from each place on that stand twice at least, by backward search; intervals of WINDOW words or more are
repeats. A hash whose segments are more than one index holds is split by content: windows of it whose digests occur several
times go on, the first and the last occurrence of each, to shards by those digests, and are searched there in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.fm_index import DEPTH, FMIndex
from spindrift.llm.shared import chunks, documents, materialize, release

WINDOW = 35
GRAM = 8
#: Words of the segments with one hash that one index takes, and from which it takes no further hash.
SHARD_WORDS = 400_000
#: Word hashes that a task remembers.
REMEMBERED = 250_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = digest(w, 7)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` (a power of two) words."""
    factor, width = np.uint64(_ODD), 1
    while width < size:
        h = _mix(h[: len(h) - width] * factor + h[width:])
        width *= 2
    return h


def _smallest(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each `span` consecutive values and its first place."""
    places = np.arange(len(values), dtype=np.int64)
    width = 1

    def join(step: int, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = v[: len(v) - step] <= v[step:]
        return np.where(left, v[: len(v) - step], v[step:]), np.where(left, p[: len(p) - step], p[step:])

    while 2 * width <= span:
        values, places = join(width, values, places)
        width *= 2
    return join(span - width, values, places) if span > width else (values, places)


def segments(words: list[list[bytes]], window: int = WINDOW, gram: int = GRAM, known: dict[bytes, int] | None = None) -> tuple[np.ndarray, ...]:
    """Owner, first word, windows, hash and digest of each segment of some documents; known: hashes of words so far."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not (sizes >= window).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    flat = _hashes([w for own in words for w in own], {} if known is None else known)
    value, place = _smallest(_grams(flat, gram), window - gram + 1)
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - window + 1)
    owner = np.repeat(np.arange(len(words)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + within
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[at[1:]] != place[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    end = begin + n + window - 1
    powers = np.ones(len(flat) + 1, np.uint64)
    powers[1:] = np.uint64(_ODD)
    powers = np.multiply.accumulate(powers)
    inverse = np.ones(len(flat) + 1, np.uint64)
    inverse[1:] = np.uint64(_INVERSE)
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * powers[:-1], out=sums[1:])
    digest = _mix((sums[end] - sums[begin]) * inverse[begin] + n.astype(np.uint64))
    return owner[first], within[first], n, value[begin].view(np.int64), digest.view(np.int64)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """did, th (hashes of id and text: rows that agree in both are treated alike), the id and the text."""
    return docs.select(F.xxhash64(F.col(doc_id).cast("string")).alias("did"), F.xxhash64(F.col(text)).alias("th"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def _packed(source: DataFrame) -> DataFrame:
    """The texts compressed, as a join is to move them."""

    def run(batches):
        for batch, texts in chunks(batches, "text"):
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), batch.column("doc_id"), pa.array([pack(t or b"") for t in texts], pa.binary())], names=["did", "th", "doc_id", "packed"])

    return source.mapInArrow(run, T.StructType([source.schema["did"], source.schema["th"], source.schema["doc_id"], T.StructField("packed", T.BinaryType())]))


def _search(rows: DataFrame, window: int) -> DataFrame:
    """h, d and bits (windows that repeat) of sequences (h, d, o, copies, words), by an FM-index of those with one h.

    Sequences of one h and d are occurrences o of one text, each given once or `copies` times.
    """

    def shard(held: dict[tuple[int, int, int], tuple[int, list[bytes]]]) -> pa.RecordBatch:
        sequences, which, names = [], [], []
        for (h, d, _), (copies, words) in held.items():
            if not names or names[-1] != (h, d):
                names.append((h, d))
                which.append(len(sequences))
            sequences += [words] * copies
        out = []
        for (h, d), reach in zip(names, FMIndex(sequences).statistics(np.array(which, np.int64)), strict=True):
            bits = sum(1 << j for j in np.flatnonzero(reach >= window).tolist())
            if bits:
                out.append((h, d, bits))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["h", "d", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[int, list[bytes]]] = {}  # an occurrence that comes several times is one
        size, last = 0, None
        for batch in batches:
            for h, d, o, copies, words in zip(*(batch.column(k).to_pylist() for k in ("h", "d", "o", "copies", "words")), strict=True):
                if size > SHARD_WORDS and h != last:
                    yield shard(held)
                    held, size = {}, 0
                if (h, d, o) not in held:
                    held[h, d, o] = copies, words.split()
                    size += len(held[h, d, o][1]) * copies
                last = h
        if held:
            yield shard(held)

    dealt = rows.select("h", "d", "o", "copies", "words").repartition("h").sortWithinPartitions("h", "d", "o")
    return dealt.mapInArrow(run, "h long, d long, bits long")


def _search_windows(hot: DataFrame, window: int) -> DataFrame:
    """_search() for sequences (and `many`: whether their text stands several times) whose hashes have too many: window by window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, d, many, text in zip(*(batch.column(k).to_pylist() for k in ("h", "d", "many", "words")), strict=True):
                words = text.split()
                own = b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(len(words) - window + 1))
                rows += [(h, d, many, j, *w) for j, w in enumerate(np.frombuffer(own, "<i8").reshape(-1, 2).tolist())]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "d", "many", "j", "w1", "w2"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, d, o, copies, text, picks in zip(*(batch.column(k).to_pylist() for k in ("h", "d", "o", "copies", "words", "picks")), strict=True):
                words = text.split()
                rows += [(p["w1"], p["w2"], xxhash.xxh64_intdigest(f"{h} {d} {o} {p['j']}") - (1 << 63), copies, b" ".join(words[p["j"] : p["j"] + window])) for p in picks]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "d", "o", "copies", "words"])

    windows = materialize(hot.where("o = 0").select("h", "d", "many", "words").mapInArrow(cut, "h long, d long, many boolean, j int, w1 long, w2 long"), "windows")
    place = F.struct("h", "d", "j")
    often = windows.groupBy("w1", "w2").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.max("many").alias("many")).where("one <> other OR many")
    picks = often.select("w1", "w2", F.explode(F.array_distinct(F.array("one", "other"))).alias("p")).groupBy("p.h", "p.d").agg(F.collect_list(F.struct("p.j", "w1", "w2")).alias("picks"))
    taken = hot.join(materialize(picks, "picks"), ["h", "d"]).mapInArrow(pick, "h long, d long, o long, copies int, words binary")
    found = materialize(_search(taken, window).select(F.col("h").alias("w1"), F.col("d").alias("w2")), "found")
    return windows.join(found, ["w1", "w2"], "left_semi").groupBy("h", "d").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """did, th and spans (first window, bits of those that repeat) of each document with repeats, and the packed source."""
    if not gram <= window <= DEPTH or window - gram > 61:
        raise ValueError(f"windows have {gram} to {min(DEPTH, gram + 61)} words")
    spark = docs.sparkSession
    source = _source(docs, doc_id, text)
    schema = "did long, th long, at int, n int, h long, d long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch, texts in chunks(batches, "text"):
            owner, at, n, h, d = segments([t.split() if t else [] for t in texts], window, gram, known)
            if len(owner):
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column("did").take(rows), batch.column("th").take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h), pa.array(d)], names=["did", "th", "at", "n", "h", "d"])

    every = materialize(source.select("did", "th", "text").mapInArrow(cut, schema), "segments")
    # the counts are written first: a join straight above their aggregation could not have its hot partitions split
    often = materialize(every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "hashes")
    found = materialize(every.join(often, "h", "left_semi"), "often")
    place = F.struct("did", "th", "at", "n")
    distinct = materialize(found.groupBy("h", "d").agg((F.count("*") > 1).alias("many"), F.min(place).alias("one"), F.max(place).alias("other")), "distinct")
    release(spark)
    words = (F.col("one.n") + (window - 1)).cast("long") * F.when(F.col("many"), 2).otherwise(1)
    kinds = materialize(distinct.groupBy("h").agg(F.sum(words).alias("words")).where(F.col("words") > shard_words).select("h", F.lit(True).alias("hot")), "kinds")
    # the first and the last occurrence, or the one place of several rows that agree in id and text, as two copies
    alone = F.col("one") == F.col("other")
    part = lambda k, of: F.struct(F.col(of).alias("p"), F.lit(k).cast("long").alias("o"))
    wanted = distinct.join(kinds, "h", "left").select("h", "d", "many", F.coalesce("hot", F.lit(False)).alias("hot"), F.when(alone & F.col("many"), 2).otherwise(1).alias("copies"), F.explode(F.when(alone, F.array(part(0, "one"))).otherwise(F.array(part(0, "one"), part(1, "other")))).alias("e"))
    flat = wanted.select("e.p.did", "e.p.th", F.struct("e.p.at", "e.p.n", "h", "d", "e.o", "copies", "many", "hot").alias("part"))
    lists = flat.groupBy("did", "th").agg(F.collect_list("part").alias("parts"))
    packed = _packed(source)
    one_row = packed.select("did", "th", "packed").join(lists.hint("shuffle_hash"), ["did", "th"])  # the texts needn't be sorted
    kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
    names = ["h", "d", "o", "copies", "many", "hot", "words"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the segments; once for each document's text, though its rows may repeat."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("did")[i].as_py(), batch.column("th")[i].as_py()
                if key in seen:
                    continue
                seen.add(key)
                words = zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py()).split()
                rows = [(p["h"], p["d"], p["o"], p["copies"], p["many"], p["hot"], b" ".join(words[p["at"] : p["at"] + p["n"] + window - 1])) for p in batch.column("parts")[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)], names=names)

    pieces = materialize(one_row.mapInArrow(fetch, "h long, d long, o long, copies int, many boolean, hot boolean, words binary"), "pieces", "zstd")
    release(spark)
    hits = _search(pieces.where("NOT hot"), window)
    if not kinds.isEmpty():
        hits = hits.unionByName(_search_windows(pieces.where("hot"), window))
    hits = materialize(hits, "hits")
    spans = found.join(hits, ["h", "d"]).groupBy("did", "th").agg(F.collect_set(F.struct("at", "bits")).alias("spans"))
    return materialize(spans, "spans"), packed


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        at, bits = s["at"], s["bits"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = (~(bits >> low) & (bits >> low) + 1).bit_length() - 1
            edge[at + low] += 1
            edge[at + low + run + window - 1] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words outside windows that stand several times anywhere, joined by spaces.

    All occurrences go. Null and empty texts have no words and keep an empty text, shorter ones than a window stay whole.
    Repeated rows repeat each other's windows; rows with one doc_id and different texts are different documents, and so is one without a
    doc_id. Ids of any type will do. Other columns are not kept; an empty table gives an empty result. Windows have gram to DEPTH words,
    else it is an error.
    """
    spans, packed = repeated(docs, doc_id, text, window, gram, shard_words)
    release(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, gone, kept = [], [], []
                for data, own in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = unpack(data).split()
                    hit = covered(len(words), own, window) if own else None
                    n.append(len(words))
                    gone.append(int(hit.sum()) if own else 0)
                    kept.append(b" ".join([w for w, x in zip(words, hit.tolist(), strict=True) if not x] if own else words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return packed.join(spans.hint("shuffle_hash"), ["did", "th"], "left").select("doc_id", "packed", "spans").mapInArrow(run, schema)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
ORACLE = {
    "op6_substrings": r"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM cut WHERE len(words) >= 35
), hashed AS (
  SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS w FROM windows
), often AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY w) AS c FROM hashed) WHERE c > 1
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM often
), gone AS (
  SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM cut
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS kept FROM (SELECT * FROM words ANTI JOIN hit USING (doc_id, pos)) GROUP BY doc_id
)
SELECT cut.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN gone ON gone.doc_id = cut.doc_id LEFT JOIN kept ON kept.doc_id = cut.doc_id
""",
}
