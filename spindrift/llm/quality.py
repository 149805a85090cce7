"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters look at overlapping chunks of WIDTH bytes, one every STRIDE bytes, that cover
the whole document; of each filter the strongest answer counts, and a logistic unit combines them into one probability.
The network learns on the driver from a bounded sample of labelled documents and scores on the executors.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import annotate, by_hash, documents, drawn, get_bytes, held, keep_rows, put_bytes, shared_dir

VECTOR = 8
WIDTH = 16
STRIDE = 4
FILTERS = 32
PAD = 256  # what follows a document's last byte
#: The training sample: labelled documents at most, characters of each (in pieces from all over its text), and bytes of these that a
#: round looks at (a window at another place in each round).
SAMPLE_DOCS = 3600
SAMPLE_PIECES = 4
PIECE_CHARS = 8192
SAMPLE_BYTES = 16_384
ROUNDS = 14
BATCH = 24
RATE = 4e-3
SEED = 5
#: Chunks scored at once.
BLOCK = 1 << 14
_STEPS = WIDTH // STRIDE


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * VECTOR) ** -0.5 * 1.4, (_STEPS, STRIDE * VECTOR, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.weights, self.offset]

    @staticmethod
    def rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in rows of STRIDE, with padding after each text; the first row and the number of chunks of each text."""
        counts = np.array([max(1, -(-len(t) // STRIDE)) for t in texts], np.int64)
        firsts = np.cumsum(counts + _STEPS - 1) - (counts + _STEPS - 1)
        flat = np.full(int((counts + _STEPS - 1).sum()) * STRIDE, PAD, np.uint16)
        for at, t in zip((firsts * STRIDE).tolist(), texts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        return flat.reshape(-1, STRIDE), firsts, counts

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """The filters' answers to the chunks that begin in each row but the last _STEPS - 1."""
        seen = self.vectors[rows].reshape(len(rows), -1)
        n = len(rows) - _STEPS + 1
        out = seen[:n] @ self.filters[0]
        for k in range(1, _STEPS):
            out += seen[k : k + n] @ self.filters[k]
        return out + self.bias

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        rows, firsts, counts = self.rows(texts)
        out = np.full((len(texts), FILTERS), -np.inf, np.float32)
        ends = firsts + counts
        for at in range(0, len(rows) - _STEPS + 1, BLOCK):
            got = self.answers(rows[at : at + BLOCK + _STEPS - 1])
            low = int(np.searchsorted(ends, at, "right"))
            high = int(np.searchsorted(firsts, at + len(got), "left"))
            for d in range(low, high):
                a, b = max(0, firsts[d] - at), min(len(got), ends[d] - at)
                if b > a:
                    np.maximum(out[d], got[a:b].max(0), out=out[d])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.maximum(self.pooled(texts), 0) @ self.weights + self.offset
        return np.round(1 / (1 + np.exp(-z.astype(np.float64))), 4)  # matrix products differ in their last digits with the batch

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        rows, firsts, counts = self.rows(texts)
        got = self.answers(rows)
        best = np.stack([first + got[first : first + n].argmax(0) for first, n in zip(firsts, counts, strict=True)])
        raw = np.take_along_axis(got, best, 0)
        pooled = np.maximum(raw, 0)
        z = pooled @ self.weights + self.offset
        error = ((1 / (1 + np.exp(-z)) - labels) * weights / len(texts)).astype(np.float32)
        back = error[:, None] * self.weights * (raw > 0)  # texts x filters
        steps = rows[best[:, :, None] + np.arange(_STEPS)]  # texts x filters x steps x bytes
        seen = self.vectors[steps].reshape(*best.shape, _STEPS, -1)
        to_filters = np.einsum("tf,tfsv->svf", back, seen)
        to_vectors = np.zeros_like(self.vectors)
        given = np.einsum("tf,svf->tfsv", back, self.filters).reshape(-1, VECTOR)
        np.add.at(to_vectors, steps.reshape(-1), given)
        return [to_vectors, to_filters, back.sum(0), pooled.T @ error, error.sum(keepdims=True)]

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Network:
        """Adam with a falling rate; both classes weigh the same in the mean of their share and a half."""
        rng = np.random.default_rng(seed)
        share = float(labels.mean())
        if share in (0.0, 1.0):  # one class only: its score for all
            self.weights[:] = 0
            self.offset[:] = 4.0 if share else -4.0
            return self
        weight = np.where(labels > 0, 1.0, min(4.0, (share / (1 - share)) ** 0.5))
        first, second, t = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        total = rounds * -(-len(texts) // BATCH)
        for _ in range(rounds):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                windows = []
                for i in picked:
                    most = max(0, len(texts[i]) - sample_bytes)
                    start = int(rng.integers(0, most + 1))
                    windows.append(texts[i][start : start + sample_bytes])
                t += 1
                rate = RATE * (1 - t / (total + 1))
                for p, g, m, v in zip(self.parts, self.gradients(windows, labels[picked], weight[picked]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def dump(self) -> bytes:
        np.savez(data := io.BytesIO(), *self.parts)
        return data.getvalue()

    @staticmethod
    def load(data: bytes) -> Network:
        own = Network.__new__(Network)
        with np.load(io.BytesIO(data)) as f:
            own.vectors, own.filters, own.bias, own.weights, own.offset = (f[f"arr_{i}"] for i in range(5))
        return own


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> list[tuple[bytes, int]]:
    """The labelled documents with the smallest hashes of their ids, at most sample_docs; null texts as empty ones.

    Of several labels of an id the mean decides (a half counts as 1). Of a text of over SAMPLE_PIECES * PIECE_CHARS characters as
    many pieces of PIECE_CHARS come, drawn from all over it; of several texts with one id the smallest counts.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    ids = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().join(marks, doc_id)
    chosen = by_hash(ids, doc_id, sample_docs).collect()
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("_label", T.IntegerType())]))
    rows = docs.select(F.col(doc_id), F.col(text).alias("_text")).join(F.broadcast(few), doc_id)
    one = rows.groupBy(doc_id).agg(F.min(drawn(F.coalesce("_text", F.lit("")), F.col(doc_id).cast("string"), SAMPLE_PIECES, PIECE_CHARS)).alias("_text"), F.first("_label").alias("_label"))
    return [(r._text.encode(), r._label) for r in one.orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id).collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> str:
    """Learn from labelled documents; returns the network's file in the shared folder. Without labels all score one half."""
    sample = labelled_sample(docs, labels, doc_id, text, label, sample_docs)
    network = Network()
    if sample:
        network.fit([t for t, _ in sample], np.array([y for _, y in sample], np.float32), rounds)
    else:
        network.weights[:] = 0
    put_bytes(path := f"{shared_dir(docs.sparkSession)}/quality.npz", network.dump())
    return path


def load_network(path: str) -> Network:
    return held(("network", path), lambda: Network.load(get_bytes(path)))


def _texts(texts: list) -> list[bytes]:
    return [t or b"" for t in texts]


def score_quality(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if at least a half); null and empty texts get one score, equal texts equal ones.

    Columns with these names are replaced.
    """

    def make():
        network = load_network(model)

        def run(texts):
            scores = network.scores(_texts(texts))
            return [scores, (scores >= 0.5).astype(np.int32)]

        return run

    return annotate(docs, text, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def keep_quality(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The documents that the network doesn't reject, with their columns as they are."""

    def make():
        network = load_network(model)
        return lambda texts: network.scores(_texts(texts)) >= 0.5

    return keep_rows(docs, text, make)


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label must not be learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit_quality(docs, labels)
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
