import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import language as L
from spindrift.llm.shared import drawn

SAMPLES = {"a": b" the cat sat on the mat ", "b": " été à la mer ".encode(), "c": b" abababab "}


@pytest.mark.parametrize(("piece", "slab"), [(L.PIECE, L.SLAB), (16, 3), (5, 100)])
def test_phrases_against_brute_force(monkeypatch, piece, slab):
    """The parse of whole texts, whatever pieces it is made in."""
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "SLAB", slab)
    automata = L.Automata(SAMPLES)

    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.text(alphabet="abcehmtséà xyz", max_size=700), min_size=1, max_size=4))
    def run(texts):
        data = [t.encode() for t in [*texts, "ab" * 300, "the cat sat on the mat " * 30]]
        found = automata.phrases(data)
        for k, name in enumerate(automata.languages):
            assert found[k].tolist() == [L.brute_phrases(t, SAMPLES[name]) for t in data]

    run()


def test_a_sample_comes_from_all_over_a_text(spark):
    text = "".join(f"{i:05d}" for i in range(20000))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([text, "short", "", None, "x" * 400, text])], "doc_id long, text string")
    got = [r.d for r in rows.orderBy("doc_id").select(drawn(F.col("text"), F.col("doc_id").cast("string"), 4, 100).alias("d")).collect()]
    assert got[1:5] == ["short", "", None, "x" * 400] and len(got[0]) == 400 and got[0] != got[5]
    assert [text.index(got[0][k * 100 : (k + 1) * 100]) // 25000 for k in range(4)] == [0, 1, 2, 3]


def test_edge_rows(spark):
    texts = [None, "", "12 34 !!", "the cat", "été", "the cat sat " * 20000, "the cat", "中文"]
    train = spark.createDataFrame([(1, "the cat sat on the mat and the dog", "en"), (2, "été à la mer avec les autres", "fr"), (3, None, "de"), (4, "hm", None), (5, "123", "num"), (1, "the cat sat on the mat and the dog", "en")], "doc_id long, text string, lang string")
    model = L.fit_languages(train)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, SCORE string")
    rows = {r.doc_id: r for r in L.predict_languages(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "fr", "en", "en"]
    assert rows[7].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in rows.values())
    assert L.predict_languages(docs.limit(0), model).count() == 0
    marks = spark.createDataFrame([(0, "\u0301"), (1, "12\u0301"), (2, "\u0661\u0662"), (3, "\u00b2 \u2460"), (4, "1a")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in L.predict_languages(marks, model).orderBy("doc_id").collect()] == [True, True, True, True, False]
    nothing = L.fit_languages(train.limit(0))
    assert {r.lang_pred for r in L.predict_languages(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = L.op7_language(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
