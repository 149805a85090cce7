"""Byte-level BPE with a transducer lexicon.

Frequent words, counted over all documents, and their ids are compiled into a minimal acyclic transducer: words with a
common ending share its states, and the outputs along a word's path add up to its number, which gives its ids. The arrays
lie in the shared folder and are memory-mapped (read whole where the file system isn't local). Words that the lexicon lacks
are merged exactly, pair by pair, so that the lexicon decides about speed only, never about ids.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from array import array
from collections import Counter
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.pieces import BYTE_CHARS, Pieces, cut, word_splitter
from spindrift.llm.shared import annotate, chunks, documents, get_bytes, held, materialize, open_fs, put_bytes, shared_dir
from spindrift.llm.token_files import default_vocabulary

#: Words in the lexicon, and counters that a task keeps (Misra-Gries: all words that are frequent enough survive).
LEXICON = 1 << 16
#: Longer words are merged, not looked up.
LONGEST = 64
#: Pieces, and words in them, that a worker remembers.
REMEMBERED = 800_000
REMEMBERED_WORDS = 450_000
_NO_RANK = 1 << 62
_LOW = (1 << 32) - 1


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, chars = spec["model"]["vocab"], {chr(c): b for b, c in BYTE_CHARS.items()}
        self.first = [ids[chr(BYTE_CHARS[b])] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]  # numbers compare faster than pairs
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: bytes(chars[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.specials.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank, the leftmost of equal ones, is merged until none is left."""
        first = self.first
        ids = [first[b] for b in word]
        rank, none = self.ranks.get, _NO_RANK
        pairs = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        if len(pairs) > 200:
            return self._merge_long(ids)
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            new = best & _LOW
            ids[i : i + 2] = (new,)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(ids[i - 1] << 32 | new, none)
            if i < len(pairs):
                pairs[i] = rank(new << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in a time that grows with n log n, for very long words."""
        from heapq import heapify, heappop, heappush

        n, rank = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r >> 32, i, ids[i], ids[i + 1], r & _LOW) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank(ids[left] << 32 | ids[right])) is not None:
                    heappush(heap, (r >> 32, left, ids[left], ids[right], r & _LOW))
        return [i for i in ids if i >= 0]


def compile_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of sorted, distinct words; the outputs on a word's path add up to its place among them."""
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    stack: list[tuple[list, list]] = [([False], [])]  # final, edges

    def close(depth: int, label: bytes) -> None:
        while len(stack) > depth + 1:
            final, edges = stack.pop()
            key = (final[0], tuple(edges))
            if (state := known.get(key)) is None:
                state = known[key] = len(states)
                states.append(key)
            stack[-1][1].append((label[len(stack) - 1], state))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared, last)
        stack.extend(([False], []) for _ in word[shared:])
        stack[-1][0][0] = True
        last = word
    close(0, last)
    states.append((stack[0][0][0], tuple(stack[0][1])))
    used = sorted({b for _, edges in states for b, _ in edges})
    classes = np.full(256, len(used), np.int32)
    classes[used] = np.arange(len(used))
    to = np.full((len(states), len(used) + 1), -1, np.int32)
    out = np.zeros_like(to)
    below = []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for b, t in edges:
            to[s, classes[b]], out[s, classes[b]] = t, n
            n += below[t]
        below.append(n)
    return {"classes": classes, "to": to, "out": out, "final": np.array([f for f, _ in states])}


class Lexicon:
    """Looks up many words at once in the transducer."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.classes, self.to, self.out, self.final, self.at, self.ids = (arrays[k] for k in ("classes", "to", "out", "final", "at", "ids"))

    @staticmethod
    def build(words: list[bytes], vocabulary: Vocabulary, split) -> dict[str, np.ndarray]:
        words = sorted(set(words))
        ids = [[i for w in split(x.decode()) for i in vocabulary.merge(w.encode())] for x in words]
        return compile_transducer(words) | {"at": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), "ids": np.array([i for x in ids for i in x], "<i4")}

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        sizes = np.array([len(w) for w in words], np.int64)
        found = np.full(len(words), -1, np.int64)
        symbols = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        alive = np.flatnonzero(sizes <= LONGEST)
        state = np.full(len(alive), len(self.to) - 1, np.int64)
        number = np.zeros(len(alive), np.int64)
        for step in range(LONGEST + 1):
            ended = sizes[alive] == step
            good = ended & self.final[state]
            found[alive[good]] = number[good]
            go = ~ended
            alive, state, number = alive[go], state[go], number[go]
            if not len(alive):
                break
            symbol = symbols[starts[alive] + step]
            number += self.out[state, symbol]
            state = self.to[state, symbol].astype(np.int64)
            go = state >= 0
            alive, state, number = alive[go], state[go], number[go]
        return found

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.at[number] : self.at[number + 1]].tolist()


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    for name, array in arrays.items():
        np.save(data := io.BytesIO(), array)
        put_bytes(f"{uri}/{name}.npy", data.getvalue())


def map_arrays(uri: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    from pyarrow import fs

    files, path = open_fs(uri)
    if isinstance(files, fs.LocalFileSystem):
        return {n: np.load(f"{path}/{n}.npy", mmap_mode="r") for n in names}
    return {n: np.load(io.BytesIO(get_bytes(f"{uri}/{n}.npy"))) for n in names}


class Coder:
    """Encodes and decodes whole texts with a vocabulary and a lexicon of it.

    What a worker remembers of a word is its ids, or where `digest` is set their decimal form (a comma before each) and the
    bytes that they decode to.
    """

    def __init__(self, path: str, lexicon: str, digest: bool = False, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.split = word_splitter(Tokenizer.from_file(path))
        self.lexicon = Lexicon(map_arrays(lexicon, ("classes", "to", "out", "final", "at", "ids")))
        specials = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.at_specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")").split if specials else lambda t: [t]
        coder, text = self, self.vocabulary.text
        if digest:
            self.value = lambda ids: ("".join([f",{i}" for i in ids]), b"".join([text[i] for i in ids]))
            join = lambda values: ("".join([a for a, _ in values]), b"".join([b for _, b in values]))
        else:
            self.value = lambda ids: array("i", ids).tobytes()
            join = b"".join

        class Words(Pieces):
            def _solve(self, pieces):
                out, missing = coder.look_up(pieces)
                found = super()._solve([pieces[i] for i in missing])
                for i, x in zip(missing, found, strict=True):
                    out[i] = x
                return out

        self.pieces = Words(self.of_words, self.of_texts, join, self.split, tuple(specials), remembered, min(remembered, REMEMBERED_WORDS))
        self.join = join

    def look_up(self, words: list[str]) -> tuple[list, list[int]]:
        numbers = self.lexicon.find([w.encode() for w in words])
        of = self.lexicon.ids_of
        return [self.value(of(n)) if n >= 0 else None for n in numbers.tolist()], np.flatnonzero(numbers < 0).tolist()

    def of_words(self, words: list[str]) -> list[bytes]:
        out, missing = self.look_up(words)
        for i in missing:
            out[i] = self.value(self.vocabulary.merge(words[i].encode()))
        return out

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Texts that can't be cut at spaces, or with special tokens."""
        out = []
        for text in texts:
            parts = [p for p in self.at_specials(text) if p]
            words = [[p] if p in self.vocabulary.specials else self.split(p) for p in parts]
            ids = self.pieces.words.values({w for p, ws in zip(parts, words, strict=True) if p not in self.vocabulary.specials for w in ws})
            out.append(self.join([v for p, ws in zip(parts, words, strict=True) for v in ([self.value([self.vocabulary.specials[p]])] if p in self.vocabulary.specials else [ids[w] for w in ws])]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as 32-bit integers."""
        return list(map(self.join, self.pieces.parts(texts)))

    def digests(self, texts: list[str], ids_too: bool = False) -> tuple[list, ...]:
        """Number of ids, and SHA-256 of their decimal form and of the text that they decode to; the ids if asked for."""
        counts, ids, decoded, numbers = [], [], [], []
        for decimal, data in map(self.join, self.pieces.parts(texts)):
            counts.append(decimal.count(","))
            ids.append(hashlib.sha256(decimal[1:].encode()).hexdigest())
            decoded.append(hashlib.sha256(self.as_text(data)).hexdigest())
            if ids_too:
                numbers.append(np.fromstring(decimal[1:], np.int32, sep=",") if decimal else np.zeros(0, np.int32))
        return (counts, ids, decoded, numbers) if ids_too else (counts, ids, decoded)

    def decode(self, ids: list[int]) -> bytes:
        """Unknown ids and nulls say nothing; bytes that aren't UTF-8 become U+FFFD."""
        get = self.vocabulary.text.get
        return self.as_text(b"".join([get(i, b"") for i in ids]))

    @staticmethod
    def as_text(data: bytes) -> bytes:
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data


def coder(*key) -> Coder:
    """Coder(*key); a worker keeps one."""
    return held(("coder", *key), lambda: Coder(*key))


def splitter(path: str):
    """The special tokens of a vocabulary, and its way to cut a text into words."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        specials = tuple(t["content"] for t in json.load(f)["added_tokens"])
    return specials, word_splitter(Tokenizer.from_file(path))


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON, path: str | None = None) -> list[bytes]:
    """The most frequent words (with the space before them) of all documents, as far as an approximate threshold tells; the driver gets `most` rows.

    Texts are cut at spaces where that is possible, else (indented lines, special tokens) as the split pattern cuts them. Each task keeps at most twice as many counters as it returns: beyond that it takes the count of the first one that it
    can't keep from all of them and drops those that reach zero.
    """
    schema = "word binary, n long"
    path = path or default_vocabulary()

    def shrink(counts: Counter) -> Counter:
        cut_off = nlargest(most + 1, counts.values())[-1] if len(counts) > most else 0
        return Counter({w: n - cut_off for w, n in counts.items() if n > cut_off})

    def run(batches):
        specials, split = held(("splitter", path), lambda: splitter(path))
        spaced, words = Counter(), Counter()  # what stands after a space, without it; and words as they are
        for _, texts in chunks(batches, text):
            for t in texts:
                own = t.decode("utf-8", "replace") if t else ""
                pieces = cut(own, specials)
                if pieces is None:
                    words.update(split(own))
                else:
                    spaced.update(pieces[1:])
                    words.update(split(pieces[0]))
            if len(spaced) + len(words) > 4 * most:
                spaced, words = shrink(spaced), shrink(words)
        for counts, space in ((shrink(spaced), " "), (shrink(words), "")):
            if counts:
                found, numbers = zip(*counts.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([f"{space}{w}".encode() for w in found], pa.binary()), pa.array(numbers, pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= LONGEST)
    counted = materialize(rows, "words")
    total = counted.count()
    if total > most:  # a threshold first, so that no task hands over more than its part of the words
        least = counted.agg(F.percentile_approx("n", F.lit(1 - most / total), F.lit(10_000))).first()[0]
        counted = counted.where(F.col("n") > least)
    return [bytes(r.word) for r in counted.limit(most).collect()]


def build_lexicon(docs: DataFrame, text: str = "text", vocabulary: str | None = None, most: int = LEXICON) -> str:
    """Compile the frequent words of docs; returns the folder of the arrays."""
    path = vocabulary or default_vocabulary()
    from tokenizers import Tokenizer

    own = Vocabulary(path)
    words = frequent_words(docs, text, most, path)
    folder = f"{shared_dir(docs.sparkSession)}/lexicon"
    save_arrays(folder, Lexicon.build(words, own, word_splitter(Tokenizer.from_file(path))))
    return folder


def bpe_encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, lexicon: str | None = None) -> DataFrame:
    """docs with the ids of each whole text; null and empty texts have none. A column named like `ids` is replaced."""
    path = vocabulary or default_vocabulary()
    folder = lexicon or build_lexicon(docs, text, path)

    def make():
        tool = coder(path, folder)

        def run(texts):
            found = tool.encode([t.decode("utf-8", "replace") if t else "" for t in texts])
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), "<i4")))]

        return run

    return annotate(docs, text, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def bpe_decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the text that the ids stand for; null ids give null, unknown ids and null elements nothing."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in df.columns if c.lower() != text.lower()]
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(text, T.StringType())])

    def run(batches):
        from spindrift.llm.bpe import decoder

        decode = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [None if x is None else decode(x) for x in (v.as_py() if v.values is None else v.values.to_numpy(zero_copy_only=False).tolist() for v in part.column(ids))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(found, pa.binary()).cast(pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def decoder(path: str):
    def make() -> Coder:
        own = Coder.__new__(Coder)
        own.vocabulary = Vocabulary(path)
        return own

    return held(("decoder", path), make).decode


def bpe_digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None, lexicon: str | None = None, ids: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text's ids, and of what they decode to; null as empty.

    Encodes and decodes in one pass, so that no id leaves the worker but those that a column named by `ids` asks for.
    """
    path = vocabulary or default_vocabulary()
    folder = lexicon or build_lexicon(docs, text, path)

    def make():
        tool = coder(path, folder, True, remembered)
        return lambda texts: list(tool.digests([t.decode("utf-8", "replace") if t else "" for t in texts], ids is not None))

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return annotate(docs, text, make, fields + ([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
