import numpy as np
import pytest
import xxhash

from spindrift.llm import simhash as S
from spindrift.llm.components import components


def brute_code(text, words=3):
    split = [w for w in (text or "").encode().translate(S._LOWER).split()]
    shingles = [b" ".join(split[i : i + words]) for i in range(len(split) - words + 1)] or ([b" ".join(split)] if split else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, linked):
    """rows: (id, value); the smallest id reachable of each."""
    label = {i: i for i, _ in rows}
    changed = True
    pairs = [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 :] if a != b and linked(x, y)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize(("bits", "budget"), [(64, 3), (40, 3), (16, 1)])
@pytest.mark.parametrize("block_rows", [1 << 20, 20])
def test_trie_links(spark, bits, budget, block_rows):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << bits, 60, dtype=np.uint64)
    codes = [int(c) ^ sum(1 << int(b) for b in rng.choice(bits, rng.integers(0, budget + 3), replace=False)) for c in base for _ in range(5)]
    codes += [int(base[0]) ^ i for i in range(70)]  # many in one block
    codes = sorted(set(codes))
    rows = list(enumerate(codes))
    to_long = lambda c: int(np.uint64(c << (64 - bits)).view(np.int64))
    df = spark.createDataFrame([(i, 0, to_long(c)) for i, c in rows], "node long, table int, code long")
    edges = S.trie_links(df.repartition(7), bits, budget, block_rows, 4, held_rows=30)
    found = {r.id: r.component for r in components(edges).collect()}
    want = brute_components(rows, lambda x, y: (x ^ y).bit_count() <= budget)
    assert {i: found.get(i, i) for i, _ in rows} == want


@pytest.mark.parametrize("step", [S.STEP, 50])
def test_repeated_codes(monkeypatch, step):
    """Every pair of members of equal and near codes comes once at least, also of more pairs than a step has; of others none."""
    monkeypatch.setattr(S, "STEP", step)
    codes = np.sort(np.array([5] * 30 + [7] * 20 + [6] + [1 << 20] * 600 + [1 << 30] * 2, np.uint64) << np.uint64(24))
    places = np.arange(len(codes))
    frontier = tuple(np.array([x]) for x in (0, len(codes), 0, len(codes), 0, 0))
    near = {(i, j) for i in places.tolist() for j in range(i + 1, len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 1}
    got = set()
    for i, j in S.walk_any(codes, frontier, 40, 1, lambda i: i):
        assert len(i) <= max(step, len(codes))
        got |= {(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == near
    labels = places.copy()
    for i, j in S.walk_any(codes, frontier, 40, 1):
        labels = S.join_labels(labels, i, j)
    want = places.copy()
    for i, j in [tuple(map(np.array, zip(*near, strict=True)))]:
        want = S.join_labels(want, i, j)
    assert (labels == want).all()


def test_many_texts_of_one_code(spark):
    """700 different texts that share over half of their shingles with repeats, and two near copies among them."""
    rng = np.random.default_rng(4)
    texts = {i: " ".join(["0"] * 120 + [f"w{x}" for x in rng.integers(0, 1 << 30, 40)]) for i in range(700)}
    texts[700] = texts[350] + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in S.near_copies(docs).collect()] == [(700, 350)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (201, 150), (None, 4)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 200: 150, 201: 150, 150: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    texts = [(5, None), (3, ""), (9, " \n"), (4, "One"), (8, "one"), (2, "a b c d e f g"), (7, "A b  c d e f g"), (6, "long text " * 40000), (1, "zz yy"), (1, "zz yy"), (None, "one")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, CODE string")
    rows = S.simhash_components(docs).collect()
    assert len(rows) == len(texts)
    short = {i: t for i, t in texts if i is not None and len(t or "") < 100}
    got = {r.doc_id: r for r in rows}
    assert all(got[i].fingerprint == f"{brute_code(t):016x}" for i, t in short.items())
    assert {i: got[i].component_id for i in got} == {5: 3, 3: 3, 9: 3, 4: 4, 8: 4, 2: 2, 7: 2, 6: 6, 1: 1, None: None}
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, brute_code(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_components(rows, lambda x, y: (x ^ y).bit_count() <= 3)
    got = S.op2_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{c:016x}", want[i]) for i, c in rows}


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, i = {}, 0
    for _ in range(40):
        base = [word() for _ in range(150)]
        for edits in (0, 0, 1, 2, 12):
            own = base[:]
            for at in rng.choice(150, edits, replace=False):
                own[at] = word()
            texts[i] = " ".join(own)
            i += 1
    texts |= {1000: "", 1001: None, 1002: "one two", 1003: "One  two", 1004: "one three"}
    sets = {k: frozenset(S.shingle_hashes(t and t.encode(), 5).tolist()) for k, t in texts.items()}
    want = brute_components(list(sets.items()), lambda x, y: len(x & y) >= 0.8 * len(x | y))
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, node int")
    kept = {r.doc_id for r in S.drop_near_copies(docs).collect()}
    should = {k for k in want if want[k] == k}
    assert kept == should
    assert S.drop_near_copies(docs).columns == docs.columns and S.drop_near_copies(docs.limit(0)).count() == 0


def test_repeated_ids_and_rows(spark):
    """Rows with one doc_id are one document with several texts: they stay or go together; ids must be integers."""
    word = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, word("a")), (2, word("a") + " end"), (2, word("b")), (3, word("c")), (3, word("c")), (4, word("b")), (None, word("a")), (5, word("d")), (5, word("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_copies(docs).collect()} == {2: 1, 4: 1}
    assert sorted((r.doc_id for r in S.drop_near_copies(docs).collect()), key=str) == [1, 3, 3, 5, 5, None]
    for run in (S.simhash_components, S.near_copies):
        with pytest.raises(TypeError, match="integer"):
            run(docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text"))


@pytest.mark.parametrize("held", [S.PREFIX_ROWS, 30])
def test_all_near_copies(spark, monkeypatch, held):
    """Short texts, and texts whose repeats differ: none may be lost."""
    monkeypatch.setattr(S, "PREFIX_ROWS", held)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = {}
    for k in range(60):
        base = [word() for _ in range(8)]
        texts[k], texts[100 + k] = " ".join(base), " ".join([*base, word()])
        base = [word() for _ in range(200)]
        texts[200 + k], texts[300 + k] = " ".join(base), " ".join(base[:20] * int(rng.integers(3, 12)) + base)
        few = [f"w{x}" for x in rng.integers(0, 3, rng.integers(5, 14))]  # of many common shingles
        texts[400 + k] = " ".join(few)
    sets = {k: frozenset(S.shingle_hashes(t.encode(), 5).tolist()) for k, t in texts.items()}
    want = brute_components(list(sets.items()), lambda x, y: len(x & y) >= 0.8 * len(x | y))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert got == {k: c for k, c in want.items() if c != k} and len(got) >= 120
