"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of a few million words and builds a suffix array of each. The words are numbered
by the vocabulary of the test items; any other word, and the end of a document, is number 0 and ends a match. Only
suffixes that begin like some test suffix (by two words, or by one where an item has one word) enter the array, as no
other can match in two words. Every suffix of every test item is binary-searched in each shard by its first WINDOW words:
the interval that it leads to holds all its places with so long a match, and where it is empty the neighbours show the longest
match. Matches of a whole window are hits; longest_matches() follows them to their ends. No document is shuffled: the test
items, in blocks of bounded size that lie in the shared folder, visit the shards.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import CHUNK_BYTES, annotate, chunks, documents, get_bytes, held, keep_rows, put_bytes, shared_dir

WINDOW = 13
#: Bytes of item text in one block of test items: what a task holds at once.
BLOCK_BYTES = 16 << 20
#: Pairs of a test suffix and a place that are followed to their ends at a time.
PAIRS = 1 << 18
#: Part of a document's words that must be hit for it to count as contaminated, as one in so many.
ONE_IN = 20

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text."""
    return text.translate(_LETTERS).split() if text else []


class Items:
    """All suffixes of a block of test items over a vocabulary of their own.

    The items lie one after another in `words`, each ended by 0; a suffix is a place in it. Suffixes with the same first `window`
    words (all words of a shorter one) are one prefix, which is searched once.
    """

    def __init__(self, rows: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        items = [(k, [number(w, len(self.vocabulary) + 1) for w in words_of(t)]) for k, t in rows]
        items = [(k, w) for k, w in items if w]
        self.names = sorted({k for k, _ in items})
        place = {k: i for i, k in enumerate(self.names)}
        self.bits = (len(self.vocabulary) + 1).bit_length()  # the greatest number fills keys up and is no word
        self.per = 63 // self.bits
        self.levels = math.ceil(window / self.per)
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.words = np.array([x for _, w in items for x in (*w, 0)], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        self.offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.item = np.repeat(np.array([place[k] for k, _ in items], np.int64), sizes)
        self.at = np.repeat(first, sizes) + self.offset
        self.left = np.repeat(sizes, sizes) - self.offset
        size = np.minimum(self.left, window)
        low, high = self._keys(size)
        both = np.concatenate([size[:, None], low], axis=1)
        _, one, self.prefix = np.unique(both, axis=0, return_index=True, return_inverse=True)
        self.prefix = self.prefix.reshape(-1)
        self.low, self.high, self.size, self.begin = low[one], high[one], size[one], self.at[one]
        window_of = (size == window) | (self.offset == 0)  # a shorter item is a window as a whole
        owned = np.unique(np.stack([self.prefix[window_of], self.item[window_of]]), axis=1)
        self.owners = owned[1]
        self.owner_at = np.searchsorted(owned[0], np.arange(len(one) + 1))
        self.firsts = np.zeros(len(self.vocabulary) + 1, bool)
        self.firsts[self.words[self.at[(self.left == 1) & (self.offset == 0)]]] = True
        inner = self.at[self.left > 1]
        self.pairs = np.unique(self.words[inner] << self.bits | self.words[inner + 1])
        size = 1 << 22  # a table of one byte for each of 4M pair hashes drops most other pairs before the exact test
        self.sieve = np.zeros(size, bool)
        self.sieve[_pair_slot(self.pairs)] = True

    def _keys(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first `size` words of each suffix as keys of `per` words each, filled up with the least and with the greatest word."""
        out = [np.zeros((len(size), self.levels), np.int64) for _ in range(2)]
        for j in range(self.levels * self.per):
            inside = j < size
            word = self.words[np.where(inside, self.at + j, 0)] if len(size) else size
            for keys, fill in zip(out, (0, (1 << self.bits) - 1), strict=True):
                keys[:, j // self.per] = keys[:, j // self.per] << self.bits | np.where(inside, word, fill)
        return out[0], out[1]


def _pair_slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


class Shard:
    """Suffix array of some documents' words, as far as they can match the items."""

    def __init__(self, items: Items, texts: list[bytes | None]):
        self.items = items
        get = items.vocabulary.get
        split = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) for w in split], np.int64)
        starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.starts = starts
        total = int((self.lengths + 1).sum())
        tail = items.levels * items.per
        ids = np.zeros(total + tail, np.int64)
        for at, words in zip(starts.tolist(), split, strict=True):
            ids[at : at + len(words)] = [get(w, 0) for w in words]
        self.ids = ids
        here = np.flatnonzero(ids[:total])
        pair = ids[here] << items.bits | ids[here + 1]
        may = np.flatnonzero(items.sieve[_pair_slot(pair)])
        if len(items.pairs) and len(may):
            spot = np.minimum(np.searchsorted(items.pairs, pair[may]), len(items.pairs) - 1)
            may = may[items.pairs[spot] == pair[may]]
        else:
            may = may[:0]
        if items.firsts.any():
            may = np.union1d(may, np.flatnonzero(items.firsts[ids[here]]))
        at = here[may]
        alive = np.ones(len(at), bool)
        keys = []
        for level in range(items.levels):
            key = np.zeros(len(at), np.int64)
            for j in range(level * items.per, (level + 1) * items.per):
                word = ids[at + j]
                alive &= word > 0  # nothing beyond a word of no item, or a document's end
                key = key << items.bits | np.where(alive, word, 0)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        self.array = at[order]
        self.keys = [k[order] for k in keys]

    def search(self, wanted: np.ndarray) -> np.ndarray:
        """For each row of keys, how many suffixes are smaller."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.array), np.int64)
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, max(0, len(self.array) - 1))
            less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for level, key in enumerate(self.keys):
                found = key[mid]
                less |= same & (found < wanted[:, level])
                same &= found == wanted[:, level]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def matching(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each prefix of the items: the part of the array that begins with it, and how many of its words match at most."""
        items = self.items
        if not len(items.size) or not len(self.array):
            none = np.zeros(len(items.size), np.int64)
            return none, none, none
        lo, hi = self.search(items.low), self.search(items.high)
        best = np.where(hi > lo, items.size, 0)
        open_ = np.flatnonzero(hi <= lo)
        for near in (lo[open_] - 1, lo[open_]):
            there = (near >= 0) & (near < len(self.array))
            k = open_[there]
            best[k] = np.maximum(best[k], self.common(items.begin[k], self.array[near[there]]))
        return lo, hi, best

    def common(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that each test suffix (a place in the items) shares with the text from a place of the shard on."""
        n, going = np.zeros(len(own), np.int64), np.arange(len(own))
        while len(going):
            x, y = self.items.words[own[going] + n[going]], self.ids[at[going] + n[going]]
            going = going[(x == y) & (x > 0)]
            n[going] += 1
        return n

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def hits(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each document: which of the shard's words are hit (over all words), and the items with a window in it."""
        items = self.items
        covered = np.zeros(len(self.ids) + 1, np.int64)
        found: list[np.ndarray] = []
        lo, hi, best = self.matching()
        for k in np.flatnonzero((best == items.size) & (hi > lo) & (np.diff(items.owner_at) > 0)):
            at = self.array[lo[k] : hi[k]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + items.size[k], -1)
            docs = np.unique(self.document_of(at))
            own = items.owners[items.owner_at[k] : items.owner_at[k + 1]]
            found.append(np.stack([np.repeat(docs, len(own)), np.tile(own, len(docs))]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        bounds = np.searchsorted(pairs[0], np.arange(len(self.starts) + 1))
        return np.cumsum(covered)[:-1] > 0, [pairs[1][bounds[i] : bounds[i + 1]] for i in range(len(self.starts))]

    def longest(self) -> tuple[np.ndarray, ...]:
        """For each test suffix with a match here: item, offset, words matched, document, word in it."""
        items = self.items
        lo, hi, best = (x[items.prefix] for x in self.matching())
        whole = hi > lo
        begin, end = np.where(whole, lo, np.maximum(lo - 1, 0)), np.where(whole, hi, np.minimum(lo + 1, len(self.array)))
        words = items.words[items.at]
        kept = np.flatnonzero((best > 1) | (best == 1) & items.firsts[words])
        n, place = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        ends = np.cumsum((end - begin)[kept])
        for s in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):  # suffixes and their places, some at a time
            number = np.arange(s, min(s + PAIRS, int(ends[-1])))
            k = np.searchsorted(ends, number, "right")
            at = self.array[end[kept][k] - (ends[k] - number)]
            got = self.common(items.at[kept[k]], at)
            order = np.lexsort((at, -got, k))
            first = order[np.concatenate([[True], np.diff(k[order]) > 0])]
            better = (got[first] > n[k[first]]) | (got[first] == n[k[first]]) & (at[first] < place[k[first]])
            n[k[first[better]]], place[k[first[better]]] = got[first[better]], at[first[better]]
        docs = self.document_of(place)
        return items.item[kept], items.offset[kept], n, docs, place - self.starts[docs]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Index the items in blocks of about block_bytes of text; files in the shared folder. The driver holds one block at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(text).cast("binary").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t") + F.length("k"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    folder, out = shared_dir(spark), []
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        put_bytes(path := f"{folder}/items-{b}", pickle.dumps(Items([(r.k, bytes(r.t)) for r in part.collect()], window)))
        out.append(path)
    return out


def _chunk_bytes(paths: list[str]) -> int:
    """Text that meets the blocks at a time: the more blocks there are to load for it, the more, up to a bound."""
    return CHUNK_BYTES * min(8, len(paths))


def _load(path: str) -> Items:
    """One block stays loaded in a worker."""
    return held(("items", path), lambda: pickle.loads(get_bytes(path)))


def scan(texts: list[bytes | None], paths: list[str]) -> tuple[list[int], list[int], list[list[str]]]:
    """Words, hit words and sorted item ids of each text, with all blocks one after another."""
    hit, names, shard = None, [set() for _ in texts], None
    for path in paths:
        items = _load(path)
        shard = Shard(items, texts)
        words, found = shard.hits()
        tops = len(texts) and int((shard.lengths + 1).sum())
        hit = words[:tops] if hit is None else hit | words[:tops]
        for own, x in zip(names, found, strict=True):
            own.update(items.names[i] for i in x.tolist())
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[shard.starts + shard.lengths] - sums[shard.starts]
    return shard.lengths.tolist(), n_hit.tolist(), [sorted(x) for x in names]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids with a window that occurs) and contaminated.

    A window is `window` consecutive words of an item, or a whole shorter item. Null and empty texts have no words and are
    never contaminated; items with a null id or text, or no word, have no window. Repeated rows and repeated items count
    for themselves; columns of docs with these names are replaced.
    """
    paths = item_blocks(benchmark, item_id, item_text, window, block_bytes)

    def make():
        def run(texts):
            n_words, n_hit, items = scan(texts, paths)
            return [n_words, n_hit, items, [h > 0 and ONE_IN * h >= n for n, h in zip(n_words, n_hit, strict=True)]]

        return run

    return annotate(docs, text, make, [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())], _chunk_bytes(paths))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of an item, with their columns as they are.

    A document with a single window goes, however long it is: a passage of the benchmark in it is no less learned there. Null and empty
    texts stay, repeated rows stay or go together, and nothing goes where the benchmark is empty.
    """
    paths = item_blocks(benchmark, item_id, item_text, window, block_bytes)

    def make():
        return lambda texts: [not h for h in scan(texts, paths)[1]]

    return keep_rows(docs, text, make, _chunk_bytes(paths))


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each test suffix (item_id, item_offset) its longest verbatim match: n_words, doc_id and word_offset.

    Matches of one word count only where that word is a window (the whole of an item, if windows are longer). The place is one
    of the longest matches'. Null and empty texts match nothing, items
    with a null id or text have no suffix, equal items of one id are one, and empty tables give an empty result.
    """
    paths = item_blocks(benchmark, item_id, item_text, window, block_bytes)
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_offset", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("word_offset", T.LongType())])

    def run(batches):
        for batch, texts in chunks(batches, "text", _chunk_bytes(paths)):
            for path in paths:
                items = _load(path)
                item, offset, n, doc, word = Shard(items, texts).longest()
                if len(item):
                    yield pa.RecordBatch.from_arrays([pa.array([items.names[i] for i in item.tolist()]), pa.array(offset), pa.array(n), batch.column("doc_id").take(pa.array(doc)), pa.array(word)], names=schema.names)

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "word_offset")).alias("m")
    return found.groupBy("item_id", "item_offset").agg(best).select("item_id", "item_offset", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.word_offset")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {
    "op10_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), cut AS (
  SELECT item, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(words[pos:pos + n - 1], ' ') AS w FROM cut
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, sizes.n AS n, words, unnest(range(1, len(words) - sizes.n + 2)) AS pos FROM docs, sizes WHERE len(words) >= sizes.n
), found AS (
  SELECT doc_id, pos, f.n AS n, item FROM (SELECT doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') AS w FROM places) f JOIN windows USING (n, w)
), hit AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS at_word FROM (SELECT DISTINCT doc_id, pos, n FROM found)) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit ON hit.doc_id = docs.doc_id LEFT JOIN own ON own.doc_id = docs.doc_id
""",
}


def brute(text: bytes | None, items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """What the tests hold scan() against."""
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
