"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is cut into the fewest
phrases that each occur in the sample (greedily, each the longest match); the phrases, weighted with the logarithm of the
sample's size and divided by the text's length, estimate the cross entropy, and the language with the smallest wins.

Letters are lower-cased and each run of other characters becomes one space. All bytes of all texts are parsed. So that many
places step through the automata at once, a text is first parsed in pieces of PIECE bytes, each as if a phrase began there; then
each piece is parsed again from the state in which its predecessor really ends, until the two parses meet in one state. The count
is that of the parse of the whole text.
"""

from __future__ import annotations

import io
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import annotate, documents, drawn, get_bytes, held, put_bytes, shared_dir

#: Bytes of normalised text in a language's sample at most, documents that it may come from, and pieces of each document's text.
SAMPLE_BYTES = 60_000
SAMPLE_DOCS = 400
SAMPLE_PIECES = 4
#: Bytes of a piece, and pieces parsed at a time.
PIECE = 256
SLAB = 1 << 13
UNKNOWN = "und"
#: Smoothing of the score: bits a byte that make a difference of one.
SCALE = 0.25


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c.lower() if c.isalpha() else c if c.isalnum() or 0x300 <= code < 0x370 else " "
        return out


_LETTERS = _Letters()


def normalise(text: str) -> bytes | None:
    """Lower-case words between single spaces, as UTF-8; None if there is no letter (digits and marks alone are none)."""
    out = " ".join(text.translate(_LETTERS).split())
    return f" {out} ".encode() if any(map(str.isalpha, out)) else None


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for b in text:
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and b not in to[p]:
            to[p][b] = new
            p = link[p]
        if p >= 0:
            q = to[p][b]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(b) == q:
                    to[p][b] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class Automata:
    """The languages' automata in one table: of a state and a symbol, twice the next state, plus one if a phrase ends there."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.bits = np.array([math.log2(len(samples[k]) + 2) for k in self.languages])
        used = sorted(set(b"".join(samples.values())))
        self.classes = np.full(256, len(used), np.int64)
        self.classes[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.starts, tables = [], []
        base = 0
        for k in self.languages:
            states = automaton(samples[k])
            table = np.zeros((len(states) + 1, self.width), np.int32)  # the last state follows a byte that no sample has
            first = np.full(self.width, 2 * (base + len(states)) + 1, np.int32)
            for b, t in states[0].items():
                first[self.classes[b]] = 2 * (base + t) + 1
            table[:] = first
            for s, edges in enumerate(states):
                for b, t in edges.items():
                    table[s, self.classes[b]] = 2 * (base + t)
            table[0] = first - 1  # the first phrase is counted by the caller
            self.starts.append(base)
            tables.append(table)
            base += len(states) + 1
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each whole text, by language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        symbols = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + within * PIECE
        length = np.minimum(PIECE, np.repeat(sizes, pieces) - within * PIECE)
        out = np.tile((sizes > 0).astype(np.int64), (len(self.languages), 1))  # the first phrase of each text
        last = np.zeros(len(self.languages), np.int64)
        for s in range(0, len(owner), SLAB):
            ends, begun = self._parse(symbols, start[s : s + SLAB], length[s : s + SLAB], within[s : s + SLAB] > 0, last)
            for row, new in zip(out, begun, strict=True):
                np.add.at(row, owner[s : s + SLAB], new)
            last = ends[:, -1]
        return out

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, goes_on: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each piece and the phrases that begin in it, by language; last: the states before the first piece."""
        kinds, many = len(self.languages), len(start)
        order = np.argsort(-length, kind="stable")
        place = np.empty(many, np.int64)
        place[order] = np.arange(many)
        begin = start[order]
        live = np.searchsorted(-length[order], -np.arange(PIECE), "left")  # pieces longer than each step
        states, sums = np.empty((PIECE, kinds, many), np.int32), np.empty((PIECE, kinds, many), np.int16)
        state, total = np.repeat(np.array(self.starts, np.int64), many).reshape(kinds, many), np.zeros((kinds, many), np.int16)
        for step, n in enumerate(live.tolist()):
            if not n:
                break
            value = self.table[state[:, :n] * self.width + symbols[begin[:n] + step]]
            state[:, :n] = states[step, :, :n] = value >> 1
            total[:, :n] += (value & 1).astype(np.int16)
            sums[step, :, :n] = total[:, :n]
        guess_end, guess_total = state[:, place], total[:, place].astype(np.int64)
        ends, begun = guess_end.copy(), guess_total.copy()
        kind, piece = np.nonzero(np.broadcast_to(goes_on, (kinds, many)))
        while len(piece):
            now = np.where(piece > 0, ends[kind, piece - 1], last[kind])
            count, going = np.zeros(len(piece), np.int64), np.arange(len(piece))
            for step in range(PIECE):
                going = going[length[piece[going]] > step]
                if not len(going):
                    break
                k, p = kind[going], piece[going]
                value = self.table[now[going] * self.width + symbols[start[p] + step]]
                now[going] = value >> 1
                count[going] += value & 1
                met = states[step, k, place[p]] == now[going]
                k, p, done = k[met], p[met], going[met]
                count[done] += guess_total[k, p] - sums[step, k, place[p]]
                now[done] = guess_end[k, p]
                going = going[~met]
            changed = now != ends[kind, piece]
            ends[kind, piece], begun[kind, piece] = now, count
            kind, piece = kind[changed], piece[changed] + 1
            follows = piece < many
            kind, piece = kind[follows], piece[follows]
            follows = goes_on[piece]
            kind, piece = kind[follows], piece[follows]
        return ends, begun

    def judge(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the share of the best one when each bit a byte costs a factor."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        clean = [normalise(t.decode("utf-8", "replace")) if t else None for t in texts]
        there = [i for i, t in enumerate(clean) if t]
        if there and self.languages:
            entropy = self.phrases([clean[i] for i in there]) * self.bits[:, None] / np.array([len(clean[i]) for i in there])
            best = entropy.argmin(0)
            share = 1 / np.exp(-(entropy - entropy.min(0)) / SCALE).sum(0)
            for i, b, s in zip(there, best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def samples_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A bounded sample of each language's text: the documents with the smallest hashes of their ids, cut off at sample_bytes.

    Rows without a language, text or letter teach nothing. The driver gets at most sample_docs texts of each language, of each
    a tenth of sample_bytes in pieces from all over the text; if few documents make the sample too short, it is just shorter.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    h = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 40))
    sizes = labelled.groupBy(F.col(lang).alias("k")).agg(F.count("*").alias("n"))  # one row a language, as every worker holds their automata anyway
    few = labelled.select(F.col(doc_id).alias("i"), F.col(lang).alias("k"), h.alias("h")).join(F.broadcast(sizes), "k").where(F.col("h") < F.lit(1.5 * sample_docs) / F.col("n") * (1 << 40) + 1)
    rank = F.row_number().over(Window.partitionBy("k").orderBy("h", "i"))  # over about one and a half samples, not over a language
    chosen = [r[0] for r in few.withColumn("r", rank).where(F.col("r") <= sample_docs).select("i").distinct().collect()]
    kinds = labelled.schema[doc_id].dataType
    picked = labelled.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField(doc_id, kinds)]))), doc_id, "left_semi")
    rows = picked.select(F.col(lang).alias("k"), F.col(doc_id).cast("string").alias("i"), drawn(F.col(text), F.col(doc_id).cast("string"), SAMPLE_PIECES, max(1, sample_bytes // 10 // SAMPLE_PIECES)).alias("t")).orderBy("k", F.xxhash64("i"), "t").collect()
    found: dict[str, list[bytes]] = defaultdict(list)
    for r in rows:
        if sum(map(len, found[r.k])) < sample_bytes and (clean := normalise(r.t)):
            found[r.k].append(clean)
    return {k: b"".join(v)[:sample_bytes] for k, v in found.items() if v}


def save_automata(automata: Automata, uri: str) -> str:
    np.savez(data := io.BytesIO(), table=automata.table, classes=automata.classes, bits=automata.bits, starts=np.array(automata.starts, np.int64), languages=np.array(automata.languages, dtype=np.str_))
    put_bytes(uri, data.getvalue())
    return uri


def load_automata(uri: str) -> Automata:
    def make() -> Automata:
        own = Automata.__new__(Automata)
        with np.load(io.BytesIO(get_bytes(uri))) as data:
            own.table, own.classes, own.bits, own.starts, own.languages = data["table"], data["classes"], data["bits"], data["starts"].tolist(), data["languages"].tolist()
        own.width = int(own.classes.max()) + 1
        return own

    return held(("automata", uri), make)


def fit_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> str:
    """Learn from labelled documents; returns the file of the automata in the shared folder."""
    return save_automata(Automata(samples_of(docs, doc_id, text, lang, sample_bytes, sample_docs)), f"{shared_dir(docs.sparkSession)}/languages.npz")


def predict_languages(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns with these names are replaced.

    Null and empty texts, and those without a letter, are `und` with score 0; so are all if nothing was learned.
    """

    def make():
        automata = load_automata(model)
        return lambda texts: list(automata.judge(texts))

    return annotate(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    return predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}


def brute_phrases(text: bytes, sample: bytes) -> int:
    """What the tests hold the automata against: greedy longest matches by searching the sample."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample and text[i : i + k] in sample:
            k += 1
        i, n = i + k, n + 1
    return n
