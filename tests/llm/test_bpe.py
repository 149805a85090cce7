import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe as B

PATH = B.default_vocabulary()
TEXTS = ["", None, "a", "one  two", " lead", "trail ", "x \n\n  y", "<|endoftext|> after \n <|endoftext|>a", "été 中文 \U0001f600 it's", "w " * 30000, "q" * 5000, "a b a b\x00", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tool(tmp_path_factory, library):
    folder = str(tmp_path_factory.mktemp("lexicon"))
    words = [b" the", b" other", b" mother", b" it's", b"a", b"", " été".encode(), b" a.\nb"]
    B.save_arrays(folder, B.Lexicon.build(words, B.Vocabulary(PATH), B.word_splitter(library)))
    return B.Coder(PATH, folder)


def test_transducer_is_minimal_and_numbers_words():
    words = sorted([b"tap", b"taps", b"top", b"tops", b"stop", b"stops"])
    arrays = B.compile_transducer(words)
    assert len(arrays["to"]) == 7  # start, s, st, t, a/o, p, end
    lexicon = B.Lexicon(arrays | {"at": None, "ids": None})
    assert lexicon.find([*words, b"to", b"", b"stopss", b"x" * 99]).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=50), st.lists(st.sampled_from(["the", "other", " ", "  ", "\n", "it's", "mother", "a.\nb", "été", "<|endoftext|>", "12", "՘"]), max_size=12).map(" ".join)))
def test_equals_library(tool, library, text):
    import numpy as np

    ids = np.frombuffer(tool.encode([text])[0], "<i4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert tool.decode(ids).decode() == library.decode(ids, skip_special_tokens=False) == text


def test_digests(tool, library, tmp_path):
    B.save_arrays(str(tmp_path), B.Lexicon.build([b" the"], B.Vocabulary(PATH), B.word_splitter(library)))
    texts = [t or "" for t in TEXTS]
    counts, ids, decoded = B.Coder(PATH, str(tmp_path), True).digests(texts)
    for text, n, a, b in zip(texts, counts, ids, decoded, strict=True):
        own = library.encode(text, add_special_tokens=False).ids
        assert (n, a, b) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decode_any_ids(tool, library, ids):
    assert tool.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_columns(spark, library):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, IDS int")
    rows = B.bpe_decode(B.bpe_encode(docs)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    assert B.bpe_encode(docs.limit(0)).count() == 0
    assert B.bpe_decode(spark.createDataFrame([(None,), ([None, 64, -5, 99999],)], "ids array<int>")).select("decoded").collect() == [(None,), ("a",)]


def test_query(spark, library, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = B.op9_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
