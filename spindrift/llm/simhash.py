"""SimHash near-dedup by self-joins of binary tries.

Codes that differ in at most `budget` bits agree in one of budget + 1 blocks, so each code is dealt out once for each block,
rotated so that this block leads. A task holds the codes of some blocks, sorted: ranges of them are the nodes of a binary
trie. Pairs of nodes are walked together from the block down, bit by bit; each step into different bits costs one of the
budget, and a pair beyond it is dropped. Small pairs of nodes are compared code by code. A block with too many codes is
split: its rows go to the pairs of trie nodes some bits further down that the budget still allows.

What a task finds leaves it as a spanning forest, so that no output grows with the square of a group, and a loop over the
forests of all tasks labels the components.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.components import components
from spindrift.llm.shared import chunks, documents, materialize, open_fs, shared_dir

WORDS = 3
BITS = 64
BUDGET = 3
#: Codes in a block from which it is split, and bits of the split.
BLOCK_ROWS = 1 << 20
SPLIT_BITS = 6
#: Code pairs under which a pair of nodes is compared at once, and compared in one step.
LEAF = 128
STEP = 1 << 18
#: Rows that a task holds at once, unless one group has more.
HELD_ROWS = 1 << 16

#: For near copies: words of a shingle, their similarity, and the codes in which they are sought: tables of so many bits each.
COPY_WORDS = 5
COPY_SIMILARITY = 0.8
COPY_TABLES = 8
COPY_BITS = 64
COPY_BUDGET = 3
COPY_HASHES = 4
#: For pairs that no table finds: shingles known as frequent, the part of the documents they are counted in (one in so many; both only
#: order the shingles), and rows that a task holds at once, unless one shingle has more.
FREQUENT = 1 << 16
FREQUENT_IN = 16
PREFIX_ROWS = 1 << 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` lower-case words, repeats included; of all words if they are fewer."""
    split = text.translate(_LOWER).split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(split) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the number whose bits are set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            total = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 14):
                total += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
            out[i] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash; h itself for k = 0."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def integer_ids(docs: DataFrame, doc_id: str) -> None:
    """An error where ids are no integers, as labels are compared as numbers."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column, not {docs.schema[doc_id].dataType.simpleString()}")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and code, the 64-bit SimHash of each whole text's shingles; 0 without words (null and empty texts)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("code", T.LongType())])

    def run(batches):
        for batch, texts in chunks(batches, "text", 1 << 20):
            codes = majority([shingle_hashes(t, words) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _halves(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where in each sorted range the bit at depth turns to 1."""
    lo, hi = lo.copy(), hi.copy()
    shift = (63 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(codes) - 1)
        one = (codes[mid] >> shift & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def walk(codes: np.ndarray, frontier: tuple[np.ndarray, ...], bits: int, budget: int):
    """Pairs of places whose codes differ in at most budget bits, in steps; frontier: both ranges, bits that differ so far, depth.

    The codes of a range are distinct, so that a leaf has at most LEAF pairs; walk_any() is for others.
    """
    held: list[tuple[np.ndarray, ...]] = [frontier]
    while held:
        alo, ahi, blo, bhi, diff, depth = held.pop()
        size = (ahi - alo) * (bhi - blo)
        small = (size <= LEAF) | (depth >= bits)
        leaf = np.flatnonzero(small & ~((alo == blo) & (ahi - alo == 1)))
        ends = np.cumsum(size[leaf])
        at = 0
        while at < len(leaf):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP, "right")))
            k = leaf[at:to]
            n = size[k]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(bhi[k] - blo[k], n)
            i, j = np.repeat(alo[k], n) + within // wide, np.repeat(blo[k], n) + within % wide
            near = (i != j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget) & ((i < j) | (np.repeat(alo[k], n) != np.repeat(blo[k], n)))
            if near.any():
                yield i[near], j[near]
            at = to
        go = np.flatnonzero(~small)
        if not len(go):
            continue
        alo, ahi, blo, bhi, diff, depth = (x[go] for x in (alo, ahi, blo, bhi, diff, depth))
        own = alo == blo
        am, bm = _halves(codes, alo, ahi, depth), _halves(codes, blo, bhi, depth)
        new = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am[~own], ahi[~own], blo[~own], bm[~own], diff[~own] + 1)]
        depths = np.concatenate([depth, depth, depth, depth[~own]]) + 1
        joined = [np.concatenate([x[i] for x in new]) for i in range(5)]
        fit = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        following = tuple(x[fit] for x in (*joined, depths))
        for s in range(0, len(following[0]), STEP):
            held.append(tuple(x[s : s + STEP] for x in following))


def root(parent: np.ndarray, i: int) -> int:
    """The smallest place of the component of i, in a forest of parents that are no larger; shortens the way there."""
    while (p := int(parent[i])) != i:
        parent[i] = parent[p]
        i = p
    return i


def settled(parent: np.ndarray) -> np.ndarray:
    """The same forest with each parent a root."""
    while ((next_ := parent[parent]) != parent).any():
        parent = next_
    return parent


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its component) after linking i and j."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


class Sets:
    """Sorted shingle hashes of documents, read from the files that sketches() wrote; remembers some bytes of them."""

    def __init__(self, folder: str, remembered: int = 32 << 20):
        self.folder, self.remembered, self.files, self.known, self.size = folder, remembered, {}, {}, 0

    def get(self, part: int, at: int, n: int) -> np.ndarray:
        if (part, at) not in self.known:
            if self.size > self.remembered:
                self.known.clear()
                self.size = 0
            self.known[part, at] = self.read(part, at, n)
            self.size += 4 * n + 200
        return self.known[part, at]

    def read(self, part: int, at: int, n: int) -> np.ndarray:
        """get() without remembering the set."""
        if part not in self.files:
            if len(self.files) > 200:
                self.files.clear()
            from pyarrow import fs

            files, path = open_fs(f"{self.folder}/{part:07d}")
            self.files[part] = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        f = self.files[part]
        f.seek(at * 4)
        return np.frombuffer(f.read(n * 4), "<u4")

    def similar(self, a: tuple[int, int, int], b: tuple[int, int, int], least: float) -> bool:
        if min(a[2], b[2]) < least * max(a[2], b[2]):
            return False
        x, y = self.get(*a), self.get(*b)
        if not len(x) or not len(y):
            return len(x) == len(y)
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared >= least * (len(both) - shared)


def _split(rows: DataFrame, keep: list[str], depth: int, split_bits: int, budget: int) -> DataFrame:
    """Rows of groups that are too large, dealt to the pairs of trie nodes split_bits further down that the budget still allows.

    A group is a node with itself (side 0), or a pair of nodes (sides 1 and 2) that differ in `spent` bits so far; `pair` is the way there.
    """
    own = F.expr(f"CAST(shiftrightunsigned(shiftleft(code, {depth}), {64 - split_bits}) AS INT)")
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << split_bits) - 1)), lambda y: F.bit_count(F.col("_own").bitwiseXOR(y)) <= budget - F.col("spent"))
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(others))
    side, mine, other = F.col("side"), F.col("_own"), F.col("_other")
    new_side = F.when(side > 0, side).when(mine == other, 0).when(mine < other, 1).otherwise(2).cast("byte")
    first, second = (F.when(side == 1, a).when(side == 2, b).otherwise(c) for a, b, c in ((mine, other, F.least(mine, other)), (other, mine, F.greatest(mine, other))))
    new = {"pair": F.col("pair") * (1 << 2 * split_bits) + first * (1 << split_bits) + second, "side": new_side, "spent": (F.col("spent") + F.bit_count(mine.bitwiseXOR(other))).cast("byte"), "level": (F.col("level") + 1).cast("byte")}
    return met.withColumns(new).select(keep)


def trie_links(rows: DataFrame, bits: int = BITS, budget: int = BUDGET, block_rows: int = BLOCK_ROWS, split_bits: int = SPLIT_BITS, sets: str | None = None, least: float = COPY_SIMILARITY, held_rows: int = HELD_ROWS) -> DataFrame:
    """A spanning forest (a, b) of the links between rows (node, table, code) of one table whose codes differ in at most budget bits.

    Codes fill the highest `bits` bits; a table may hold a code any number of times. With `sets`, rows also have part, at and n, and a
    link holds only if the shingle sets have a similarity of `least`: that is looked up unless the two are linked already.
    """
    blocks = budget + 1
    width = bits // blocks
    place = rows.select("*", F.explode(F.array([F.lit(r) for r in range(blocks)])).alias("turn"))
    own = f"shiftrightunsigned(code, {64 - bits})"
    if bits < 64:
        turned = f"shiftleft((shiftleft({own}, turn * {width}) | shiftrightunsigned({own}, {bits} - turn * {width})) & {(1 << bits) - 1}L, {64 - bits})"
    else:
        turned = f"shiftleft(code, turn * {width}) | CASE WHEN turn = 0 THEN 0L ELSE shiftrightunsigned(code, 64 - turn * {width}) END"
    place = place.withColumn("code", F.expr(turned)).withColumn("block", F.shiftrightunsigned("code", 64 - width).cast("int"))
    group = ["table", "turn", "block", "level", "pair"]
    keep = [*group, "side", "spent", "node", "code", *(["part", "at", "n"] if sets else [])]
    now = place.withColumns({"level": F.lit(0).cast("byte"), "pair": F.lit(0).cast("long"), "side": F.lit(0).cast("byte"), "spent": F.lit(0).cast("byte")}).select(keep)
    dealt, level = None, 0
    while True:
        depth = width + split_bits * level
        deeper = depth + split_bits <= bits and 2 * split_bits * (level + 1) < 63
        hot = materialize(now.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).drop("_n"), "hot") if deeper else None
        if hot is None or hot.isEmpty():
            dealt = now if dealt is None else dealt.unionByName(now)
            break
        part = now.join(hot, group, "left_anti").select(keep)
        dealt = part if dealt is None else dealt.unionByName(part)
        now, level = _split(now.join(hot, group, "left_semi"), keep, depth, split_bits, budget), level + 1
    schema = "a long, b long"

    def forest_of(got: dict[str, np.ndarray], lookup: Sets | None) -> pa.RecordBatch | None:
        key = (got["table"].astype(np.int64) << 48) | (got["turn"].astype(np.int64) << 40) | got["block"].astype(np.int64)
        codes = got["code"].view(np.uint64)
        order = np.lexsort((got["node"], codes, got["side"], got["pair"], got["level"], key))
        got = {k: v[order] for k, v in got.items() if k in ("level", "pair", "side", "spent", "node", "part", "at", "n")}
        key, codes = key[order], codes[order]
        names, local = np.unique(got["node"], return_inverse=True)
        forest = np.arange(len(names))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (got["level"][1:] != got["level"][:-1]) | (got["pair"][1:] != got["pair"][:-1])]))
        ends = np.append(starts[1:], len(key))
        plain = got["side"][starts] == 0  # a node with itself; else the rows of the pair's first node come before those of its second
        cut = starts + np.add.reduceat((got["side"] == 1).astype(np.int64), starts)
        alo, ahi, blo, bhi = starts, np.where(plain, ends, cut), np.where(plain, starts, cut), ends
        apart, depth = got["spent"][starts].astype(np.int64), width + split_bits * got["level"][starts].astype(np.int64)
        fit = (alo < ahi) & (blo < bhi)
        label = None if lookup is None else lambda i: settled(forest)[local[i]]
        for i, j in walk_any(codes, tuple(x[fit] for x in (alo, ahi, blo, bhi, apart, depth)), bits, budget, label):
            a, b = local[i], local[j]
            if lookup is None:
                forest = join_labels(forest, a, b)
                continue
            forest = settled(forest)
            for x in np.flatnonzero(forest[a] != forest[b]).tolist():
                u, v = root(forest, a[x]), root(forest, b[x])
                if u != v and lookup.similar(*((int(got["part"][y]), int(got["at"][y]), int(got["n"][y])) for y in (i[x], j[x])), least):
                    forest[max(u, v)] = min(u, v)
        forest = settled(forest)
        linked = np.flatnonzero(forest != np.arange(len(forest)))
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[forest[linked]])], names=["a", "b"]) if len(linked) else None

    def run(batches):
        """Whole groups, as they come sorted, some at a time."""
        lookup = Sets(sets) if sets else None
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def joined() -> dict[str, np.ndarray]:
            return {k: np.concatenate([h[k] for h in held]) for k in keep}

        for batch in batches:
            if batch.num_rows:
                held.append({k: batch.column(k).to_numpy() for k in keep})
                size += batch.num_rows
            if size >= held_rows:
                got = joined()
                changes = np.flatnonzero(np.any([got[k][1:] != got[k][:-1] for k in group], axis=0))
                if len(changes):
                    at = int(changes[-1]) + 1
                    found = forest_of({k: v[:at] for k, v in got.items()}, lookup)
                    if found is not None:
                        yield found
                    got = {k: v[at:] for k, v in got.items()}
                held, size = [got], len(got["node"])
        if size:
            found = forest_of(joined(), lookup)
            if found is not None:
                yield found

    return dealt.select(keep).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def member_pairs(first: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, label):
    """Places of members of the buckets u and v, pair by pair, at most STEP at a time; of u = v each pair once.

    Large buckets are gone through member by member, and only by pairs whose labels still differ.
    """
    n = size[u] * size[v]
    few = n <= STEP
    ends = np.cumsum(n[few])
    for at in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        number = np.arange(at, min(at + STEP, int(ends[-1])))
        k = np.searchsorted(ends, number, "right")
        within, p, q = number - (ends - n[few])[k], u[few][k], v[few][k]
        i, j = first[p] + within // size[q], first[q] + within % size[q]
        keep = (p != q) | (i < j)
        yield i[keep], j[keep]
    for p, q in zip(u[~few].tolist(), v[~few].tolist(), strict=True):
        for i in range(int(first[p]), int(first[p] + size[p])):
            for at in range(i + 1 if p == q else int(first[q]), int(first[q] + size[q]), STEP):
                j = np.arange(at, min(at + STEP, int(first[q] + size[q])))
                j = j[label(j) != label(np.array([i]))]
                if len(j):
                    yield np.full(len(j), i), j


def walk_any(codes: np.ndarray, frontier: tuple[np.ndarray, ...], bits: int, budget: int, label=None):
    """walk(), where a group may hold a code several times: the places of a code are a bucket, which goes on as one.

    Without `label` near codes are links: buckets chain up, and one place of each goes on. With it (from places to what they are
    linked to by now), a near code is only a candidate: all pairs of members follow, of a bucket and of two near ones.
    """
    alo, ahi, blo, bhi = frontier[:4]
    if not len(codes) or not len(alo):
        return
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    bounds = np.concatenate([alo, ahi, blo, bhi])
    new[bounds[bounds < len(codes)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(codes)))
    ranges = [np.searchsorted(first, x) for x in (alo, ahi, blo, bhi)]
    many = np.flatnonzero(size > 1)
    if len(many):
        own = np.flatnonzero((alo == blo) & (ahi == bhi))
        own = own[np.argsort(ranges[0][own], kind="stable")]
        if len(own):
            k = np.searchsorted(ranges[0][own], many, "right") - 1
            many = many[(k >= 0) & (many < ranges[1][own][k])]
        else:
            many = many[:0]
        inside = np.repeat(first[many], size[many] - 1) + np.arange(int((size[many] - 1).sum())) - np.repeat(np.cumsum(size[many] - 1) - (size[many] - 1), size[many] - 1)
        if len(inside):
            yield inside, inside + 1
            if label is not None:
                yield from member_pairs(first, size, many, many, label)
    for u, v in walk(codes[first], (*ranges, *frontier[4:]), bits, budget):
        if label is None:
            yield first[u], first[v]
        else:
            yield from member_pairs(first, size, u, v, label)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, budget: int = BUDGET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: the smallest doc_id that links lead to, itself included.

    Texts without words (null, empty) have fingerprint zero and are linked like any other. Rows with one doc_id are one document;
    without a doc_id they have no component. One row comes out for each row of docs; an empty table gives an empty result. doc_id must be of
    an integer type.
    """
    integer_ids(docs, doc_id)
    prints = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("node")), "codes")
    edges = trie_links(nodes.where("node IS NOT NULL").select("node", F.lit(0).alias("table"), "code"), 64, budget, block_rows)
    again = prints.join(nodes, "code").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = again.groupBy("a").agg(F.count("*").alias("n"), F.collect_set("b").alias("bs")).where("n > 1").select("a", F.explode("bs").alias("b"))
    found = components(edges.unionByName(repeated))
    labelled = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("code", F.coalesce("component", "node").alias("component"))
    out = prints.join(labelled, "code", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def sketches(docs: DataFrame, doc_id: str, text: str, words: int, hashes: int) -> tuple[DataFrame, str]:
    """doc_id, whole (a hash of the shingle set), n, part, at (where its sorted 32-bit hashes lie) and codes (SimHashes of the distinct shingles) of each document."""
    folder = f"{shared_dir(docs.sparkSession)}/sets"
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches):
        part = TaskContext.get().partitionId()
        out, at, partial = None, 0, f"{folder}/{part:07d}.{uuid.uuid4().hex}.tmp"
        for batch, texts in chunks(batches, "text", 1 << 20):
            if out is None:
                files, path = open_fs(partial)
                files.create_dir(os.path.dirname(path), recursive=True)
                out = files.open_output_stream(path)
            found = [np.unique(shingle_hashes(t, words)) for t in texts]
            sets = [np.unique((h >> np.uint64(32)).astype("<u4")) for h in found]
            out.write(b"".join(x.tobytes() for x in sets))
            sizes = np.array([len(x) for x in sets], np.int64)
            codes = np.stack([majority([mixed(h, k) for h in found]) for k in range(hashes)], 1).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole), pa.array(sizes.astype(np.int32)), pa.array(np.full(len(sets), part, np.int32)), pa.array(starts), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * hashes), pa.array(codes.reshape(-1)))], names=schema.names)
        if out is not None:
            out.close()
            _, final = open_fs(f"{folder}/{part:07d}")
            files.move(path, final)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(source.mapInArrow(run, schema), "sketches"), folder


def table_bits(table: int, hashes: int = COPY_HASHES, bits: int = COPY_BITS) -> list[int]:
    """Which bits of the codes make a table, drawn by a fixed rule."""
    return sorted(np.random.default_rng(1000 + table).choice(64 * hashes, bits, replace=False).tolist())


def frequent_shingles(nodes: DataFrame, folder: str) -> np.ndarray:
    """The shingles with most sets among a part of the nodes (part, at, n), rising; at most FREQUENT of them, in two sets at least."""

    def run(batches):
        lookup = Sets(folder)
        for batch in batches:
            for part, at, n in zip(*(batch.column(k).to_pylist() for k in ("part", "at", "n")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(lookup.read(part, at, n).view(np.int32))], names=["key"])

    sample = nodes.where(F.pmod(F.xxhash64("doc_id"), F.lit(FREQUENT_IN)) == 0).select("part", "at", "n").mapInArrow(run, "key int")
    counted = sample.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "key").limit(FREQUENT)
    return np.array([r.key for r in counted.collect()][::-1], np.int32).view("<u4")


def prefix_links(nodes: DataFrame, folder: str, least: float) -> DataFrame:
    """A forest (a, b) of all links between nodes (doc_id, label, part, at, n) of different labels, whose sets have a similarity of `least`.

    In one order of all shingles, frequent ones last, two such sets share one of their first n - least * n + 1 shingles each. Sets meet
    by those; pairs of the same label, and those whose sizes or remaining shingles don't allow the similarity, aren't compared.
    """
    frequent = frequent_shingles(nodes, folder)
    names = ["key", "pos", "node", "part", "at", "n"]
    schema = "key int, pos int, node long, part int, at long, n int"
    rank = np.argsort(frequent, kind="stable")
    known = frequent[rank]

    def deal(batches):
        lookup = Sets(folder)
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in ("label", "part", "at", "n")]
            for s in range(0, batch.num_rows, 64):
                keys, sizes = [], []
                for part, at, n in zip(*(r[s : s + 64].tolist() for r in rows[1:]), strict=True):
                    x = lookup.read(part, at, n)
                    late = np.zeros(n, np.int64)
                    if len(known):
                        spot = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        late = np.where(known[spot] == x, rank[spot] + 1, 0)
                    keys.append(x[np.argsort(late, kind="stable")[: n - int(np.ceil(least * n - 1e-9)) + 1]])
                    sizes.append(len(keys[-1]))
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                label, part, at, n = (np.repeat(r[s : s + 64], sizes) for r in rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int32)), pa.array(pos), pa.array(label), pa.array(part), pa.array(at), pa.array(n)], names=names)

    def forest_of(got: dict[str, np.ndarray], lookup: Sets) -> pa.RecordBatch | None:
        order = np.lexsort((got["node"], got["n"], got["key"]))
        got = {k: v[order] for k, v in got.items()}
        starts = np.flatnonzero(np.concatenate([[True], got["key"][1:] != got["key"][:-1]]))
        mixed_ = np.minimum.reduceat(got["node"], starts) != np.maximum.reduceat(got["node"], starts)
        use = np.repeat(mixed_, np.diff(np.append(starts, len(order))))
        if not use.any():
            return None
        got = {k: v[use] for k, v in got.items()}
        group = np.cumsum(np.concatenate([[0], got["key"][1:] != got["key"][:-1]])).astype(np.int64) << 32
        n, pos = got["n"].astype(np.int64), got["pos"].astype(np.int64)
        c = np.searchsorted(group | n, group | np.floor(n / least + 1e-9).astype(np.int64), "right") - np.arange(len(n)) - 1
        ends = np.cumsum(c)
        labels, local = np.unique(got["node"], return_inverse=True)
        forest = np.arange(len(labels))
        for s in range(0, int(ends[-1]), STEP):
            number = np.arange(s, min(s + STEP, int(ends[-1])))
            i = np.searchsorted(ends, number, "right")
            j = i + 1 + number - (ends - c)[i]
            shared = np.minimum(n[i] - pos[i], n[j] - pos[j])
            forest = settled(forest)
            fit = np.flatnonzero((forest[local[i]] != forest[local[j]]) & (shared >= least / (1 + least) * (n[i] + n[j]) - 1e-9))
            for i_, j_ in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                u, v = root(forest, local[i_]), root(forest, local[j_])
                if u != v and lookup.similar(*((int(got["part"][y]), int(got["at"][y]), int(got["n"][y])) for y in (i_, j_)), least):
                    forest[max(u, v)] = min(u, v)
        forest = settled(forest)
        linked = np.flatnonzero(forest != np.arange(len(forest)))
        return pa.RecordBatch.from_arrays([pa.array(labels[linked]), pa.array(labels[forest[linked]])], names=["a", "b"]) if len(linked) else None

    def run(batches):
        """All rows of a shingle, as they come sorted, of some shingles at a time."""
        lookup, held, size = Sets(folder), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append({k: batch.column(k).to_numpy() for k in names})
                size += batch.num_rows
            if size >= PREFIX_ROWS:
                got = {k: np.concatenate([h[k] for h in held]) for k in names}
                at = int(np.searchsorted(got["key"], got["key"][-1]))
                if at and (found := forest_of({k: v[:at] for k, v in got.items()}, lookup)) is not None:
                    yield found
                held = [{k: v[at:] for k, v in got.items()}]
                size = len(held[0]["key"])
        if size and (found := forest_of({k: np.concatenate([h[k] for h in held]) for k in names}, lookup)) is not None:
            yield found

    dealt = nodes.select("label", "part", "at", "n").mapInArrow(deal, schema)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = COPY_WORDS, least: float = COPY_SIMILARITY, tables: int = COPY_TABLES) -> DataFrame:
    """doc_id and component_id of the documents that are copies or near copies of one with a smaller doc_id, their component's smallest.

    Near copies share at least `least` of their sets of `words`-word shingles (as 32-bit hashes, of which one text would need tens of thousands
    for a chance collision to matter). Pairs are sought in `tables` tables of COPY_BITS of a 256-bit SimHash, each joined with itself with
    COPY_BUDGET errors, and compared by their sets; prefix_links() finds the rest, so that no pair is lost. Texts of fewer words are one
    shingle; those without words (null, empty) are copies of each other. Rows without a doc_id are never copies. Rows with one doc_id are one
    document with several texts: it is linked through each of them. doc_id must be of an integer type; an empty table gives an empty result.
    """
    integer_ids(docs, doc_id)
    rows, folder = sketches(docs, doc_id, text, words, COPY_HASHES)
    rows = rows.where("doc_id IS NOT NULL")
    nodes = materialize(rows.groupBy("whole", "n").agg(F.min_by(F.struct("doc_id", "part", "at", "codes"), "doc_id").alias("m")).select("whole", "n", "m.*"), "sets")
    picks = [table_bits(t) for t in range(tables)]
    schema = "node long, table int, code long, part int, at long, n int"

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, COPY_HASHES)
            flat = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
            weights = np.uint64(1) << np.arange(63, 63 - COPY_BITS, -1).astype(np.uint64)
            for t, pick in enumerate(picks):
                code = (flat[:, pick].astype(np.uint64) * weights).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(code), t, np.int32)), pa.array(code), batch.column("part"), batch.column("at"), batch.column("n")], names=["node", "table", "code", "part", "at", "n"])

    dealt = nodes.where("n > 0").select("doc_id", "codes", "part", "at", "n").mapInArrow(deal, schema)
    edges = trie_links(dealt, COPY_BITS, COPY_BUDGET, sets=folder, least=least)
    found = components(edges)
    sought = nodes.where("n > 0").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("label"), "part", "at", "n")
    rest = prefix_links(materialize(sought, "sought"), folder, least)
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))
    labelled = nodes.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("whole", "n", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.select("doc_id", "whole", "n").join(labelled, ["whole", "n"]).where("doc_id > component_id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = COPY_WORDS, least: float = COPY_SIMILARITY) -> DataFrame:
    """docs without those that near_copies() finds; the smallest doc_id of each group stays.

    Rows with one doc_id are one document: they stay or go together, repeated rows among them.
    """
    gone = near_copies(docs, doc_id, text, words, least).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[doc_id].cast("long") == gone["_gone"], "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
