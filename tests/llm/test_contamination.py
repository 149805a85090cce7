import duckdb
import numpy as np
import pytest

from spindrift.llm import contamination as C

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "Short item here"), (2, "word"), (3, None), (None, "alpha beta"), (4, "..."), (2, "word")]
LONG = "filler text " * 30000
TEXTS = [
    "x ONE two, three four five six seven eight nine ten eleven twelve thirteen y",
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen short item here",
    None, "", "word", "WORD word Word", "short item", "alpha beta", "été word ß", LONG + "short-item-here", LONG,
]


def rows(spark, items, texts):
    docs = spark.createDataFrame([(i, t, "a", i) for i, t in enumerate(texts)], "doc_id long, text string, items string, N_WORDS int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    docs, bench = rows(spark, ITEMS, TEXTS)
    items = [(str(k), t.encode()) for k, t in ITEMS if k is not None and t is not None]
    found = {r.doc_id: r for r in C.contamination(docs, bench, block_bytes=block_bytes).collect()}
    for i, t in enumerate(TEXTS):
        n, hit, names = (60003, 3, ["10"]) if t == LONG + "short-item-here" else (60000, 0, []) if t == LONG else C.brute(t and t.encode(), items)
        r = found[i]
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names), t and t[:40]
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    left = C.decontaminate(docs, bench, block_bytes=block_bytes)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i in found if not found[i].n_hit}


def fast(text, items, window=C.WINDOW):
    """brute(), by a table of all windows: words, hit words and items of a text of any length."""
    words, hit, names = C.words_of(text), set(), set()
    for size in {min(window, len(C.words_of(t))) for _, t in items} - {0}:
        places = {}
        for j in range(len(words) - size + 1):
            places.setdefault(tuple(words[j : j + size]), []).append(j)
        for name, item in items:
            own = C.words_of(item)
            if min(window, len(own)) == size:
                for i in range(len(own) - size + 1):
                    for j in places.get(tuple(own[i : i + size]), ()):
                        hit.update(range(j, j + size))
                        names.add(name)
    return len(words), len(hit), sorted(names)


def test_a_passage_in_a_long_text_is_enough(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 500, n))
    item = word(25)
    texts = [word(9000) + " " + " ".join(item.split()[5:18]) + " " + word(4000), word(9000) + " " + " ".join(item.split()[5:17]) + " " + word(4000)]
    docs, bench = rows(spark, [(1, item)], texts)
    assert [r.doc_id for r in C.decontaminate(docs, bench).collect()] == [1]
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in C.contamination(docs, bench).collect()} == {0: (13, False), 1: (0, False)}


@pytest.mark.parametrize("words", [3, 7, 15])
def test_small_vocabularies(spark, words):
    """Words with the greatest number, next to what fills keys up."""
    rng = np.random.default_rng(words)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, words, n))
    items, texts = [(i, word(int(rng.integers(1, 30)))) for i in range(6)], [word(int(rng.integers(0, 200))) for _ in range(12)] + [f"v{words - 1} " * 40]
    docs, bench = rows(spark, items, texts)
    for r in C.contamination(docs, bench, window=4).collect():
        assert (r.n_words, r.n_hit, r["items"]) == C.brute(texts[r.doc_id].encode(), [(str(k), t.encode()) for k, t in items], 4)


def test_longest_match(spark):
    docs, bench = rows(spark, ITEMS[:2], TEXTS[:2])
    best = {(r.item_id, r.item_offset): (r.n_words, r.doc_id, r.word_offset) for r in C.longest_matches(docs, bench).collect()}
    assert best["1", 0] == (13, 0, 1) and best["1", 1] == (13, 1, 0) and best["10", 0] == (3, 1, 13)


def test_longest_match_of_every_offset(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 12, n)]
    items = [(1, word(30)), (2, word(14)), (3, word(5)), (4, ["v3"]), (5, word(30))]
    texts = [word(60), items[0][1][17:] + ["x"], ["y"] + items[4][1][20:29], word(3), ["v3"]]
    docs, bench = rows(spark, [(k, " ".join(t)) for k, t in items], [" ".join(t) for t in texts])
    want = {}
    for k, t in items:
        for i in range(len(t)):
            best = 0
            for d in texts:
                for j in range(len(d)):
                    n = 0
                    while i + n < len(t) and j + n < len(d) and t[i + n] == d[j + n]:
                        n += 1
                    best = max(best, n)
            if best > 1 or best and t[i] == "v3":
                want[str(k), i] = best
    found = C.longest_matches(docs, bench).collect()
    assert {(r.item_id, r.item_offset): r.n_words for r in found} == want
    own = dict(items)
    assert all(texts[r.doc_id][r.word_offset : r.word_offset + r.n_words] == own[int(r.item_id)][r.item_offset : r.item_offset + r.n_words] for r in found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_longest_match_of_odd_rows(spark, block_bytes):
    """Null and empty texts, nulls among ids, repeated rows and items, empty tables."""
    docs, bench = rows(spark, [*ITEMS, (1, None), (7, "")], [*TEXTS[:8], TEXTS[0], TEXTS[0]])
    found = {(r.item_id, r.item_offset): r for r in C.longest_matches(docs, bench, block_bytes=block_bytes).collect()}
    assert found["1", 0].n_words == 13 and found["1", 0].doc_id in (0, 8, 9) and found["2", 0].n_words == 1
    assert {k for k, _ in found} == {"1", "10", "2"} and [found["10", i].n_words for i in range(2)] == [3, 2]
    assert C.longest_matches(docs.limit(0), bench).count() == 0 and C.longest_matches(docs, bench.limit(0)).count() == 0


def test_empty_tables(spark):
    docs, bench = rows(spark, ITEMS, TEXTS)
    assert C.contamination(docs.limit(0), bench).count() == 0
    assert C.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_query_against_brute_force(spark, sf_dir):
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hit = 0
    for r in C.op10_decontamination(spark, sf_dir).collect():
        n, h, names = fast(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(names), C.items_digest(names))
        hit += h > 0
    assert hit
    with duckdb.connect() as own:
        for t in ("documents", "benchmark"):
            own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        assert sorted(own.execute(C.ORACLE["op10_decontamination"]).fetchall()) == sorted(tuple(r) for r in C.op10_decontamination(spark, sf_dir).collect())
