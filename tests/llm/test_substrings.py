import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import substrings as S
from spindrift.llm.fm_index import FMIndex


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=30), min_size=1, max_size=8))
def test_statistics_against_brute_force(sequences):
    got = FMIndex(sequences).statistics(np.arange(len(sequences)))
    grams = Counter(tuple(s[i : i + n]) for s in sequences for i in range(len(s)) for n in range(1, len(s) - i + 1))
    for s, row in zip(sequences, got, strict=True):
        assert row.tolist() == [max([n for n in range(1, len(s) - i + 1) if grams[tuple(s[i : i + n])] > 1], default=0) for i in range(len(s))]


def test_all_sequences_search_in_shared_rounds(monkeypatch):
    """A round grows or shortens every match, so that rounds follow the longest sequence, not the number of sequences."""
    rng, rounds, own = np.random.default_rng(4), [], FMIndex.extend
    monkeypatch.setattr(FMIndex, "extend", lambda self, symbol, lo, hi: rounds.append(len(lo)) or own(self, symbol, lo, hi))
    FMIndex([[b"%d" % x for x in rng.integers(0, 30, 60)] for _ in range(400)]).statistics(np.arange(400))
    assert rounds[0] == 400 and len(rounds) <= 2 * 60


def brute(rows, window):
    """In the order of rows: words, removed, kept."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        hit = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                hit.update(range(k, k + window))
        out.append((i, len(w), len(hit), b" ".join(x for k, x in enumerate(w) if k not in hit).decode()))
    return out


def cases():
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, long = word(60), word(300)
    rows = [(i, " ".join(word(int(rng.integers(0, 120))))) for i in range(40)]
    rows += [(100 + i, " ".join(word(20) + passage[int(rng.integers(0, 20)) : int(rng.integers(45, 60))] + word(30))) for i in range(30)]
    for i in range(40):  # near copies
        own = long[:]
        own[int(rng.integers(0, 300))] = f"edit{i}"
        rows.append((200 + i, " ".join(own)))
    rows += [(300, None), (301, ""), (302, "x " * 200), (303, "a b " * 100), (304, " ".join(word(35))), (305, "q\x1cr   s"), (306, "the same\ttext\n" * 3), (306, "the same\ttext\n" * 3), (307, "one " * 34)]
    same = " ".join(word(50))
    return rows + [(308, same), (308, same), (309, same + " more"), (None, " ".join(word(50))), (None, passage and " ".join(passage)), (310, "one " * 34)]


@pytest.mark.parametrize(("window", "shard_words"), [(35, S.SHARD_WORDS), (35, 200), (35, 0), (12, S.SHARD_WORDS), (60, 150)])
def test_against_brute_force(spark, window, shard_words):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = [tuple(r) for r in S.remove_repeats(docs.repartition(5), window=window, shard_words=shard_words).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_the_index_decides(spark, monkeypatch):
    """No repeat comes from digests alone: without what the indexes find, nothing is removed."""
    docs = spark.createDataFrame([(i, t, 1) for i, t in cases()], "doc_id long, text string, n int")
    none = lambda rows, window: rows.select("h", "d", F.lit(0).cast("long").alias("bits")).where("bits > 0")
    monkeypatch.setattr(S, "_search", none)
    assert S.remove_repeats(docs, shard_words=200).where("n_removed > 0").count() == 0


def test_windows_that_no_index_takes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for window, gram in ((65, 8), (64, 2), (5, 8)):
        with pytest.raises(ValueError, match="windows have"):
            S.remove_repeats(docs, window=window, gram=gram)


def test_ids_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("a", text), ("b", f"x {text} y"), ("b", "x y")], "doc_id string, text string")
    assert sorted((r.doc_id, r.kept) for r in S.remove_repeats(docs).collect()) == [("a", ""), ("b", "x y"), ("b", "x y")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 35))
    assert sorted(tuple(r) for r in S.op6_substrings(spark, sf_dir).collect()) == want
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert sorted(own.execute(S.ORACLE["op6_substrings"]).fetchall()) == want
