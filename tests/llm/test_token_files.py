import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import token_files as K

TEXTS = ["", None, "a", "one  two", " lead", "trail ", "tab\t x", "x \n\n  y", "<|endoftext|> after \n <|endoftext|>", "été 中文 字 \U0001f600 it's", "w " * 50000, "a  b", "same", "same"]


@pytest.fixture(scope="module")
def tool():
    return K.Encoder(K.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r  ab'st1é中\U0001f600.!")), max_size=40))
def test_pieces_equal_library(tool, text):
    assert tool.encode([text]) == tool.direct([text])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_library(tool, text):
    assert tool.encode([text]) == tool.direct([text])


def brute(tool, rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tool.library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("partitions", [1, 3])
def test_round_trip(spark, tool, partitions):
    rows = list(enumerate(TEXTS))[::-1]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    index = K.write_token_files(docs, length=16, sequences=4, partitions=partitions)
    assert sorted(tuple(r) for r in K.read_token_files(index).collect()) == brute(tool, rows)
    reader = K.PartReader(index.first().file)
    assert len(reader.sequence(0)) == 16 and len(reader.mask(0)) == 16
    first = index.orderBy("file", "row").where("row = 0").first()
    own = K.PartReader(first.file)
    assert np.concatenate(list(own.document(0)))[-1] == 0 and own.bounds["doc_id"][0].as_py() == first.doc_id
    assert K.read_token_files(K.write_token_files(docs.limit(0))).count() == 0


def test_files_that_do_not_fit(spark, tmp_path):
    """Ids without the end id, and a mask that claims padding, are errors when read."""
    docs = spark.createDataFrame([(1, "some words"), (2, "more")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not end with id 0"):
        wrong = K.write_token_files(docs, end=5, partitions=1)
        path = wrong.first().file.removeprefix("file://")
        table = pa.ipc.open_file(path).read_all()
        with pa.ipc.new_file(path + ".new", table.schema.with_metadata({"end": "0"})) as f:
            f.write_table(table.replace_schema_metadata({"end": "0"}))
        os.replace(path + ".new", path)
        K.read_token_files(wrong).collect()
    with pytest.raises(Exception, match="do not agree"):
        wrong = K.write_token_files(docs, partitions=1)
        path = wrong.first().file.removeprefix("file://")
        table = pa.ipc.open_file(path).read_all()
        full = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(table.num_rows * K.LENGTH, bool)), K.LENGTH)
        with pa.ipc.new_file(path + ".new", table.schema) as f:
            f.write_table(table.set_column(1, table.schema.field(1), full))
        os.replace(path + ".new", path)
        K.read_token_files(wrong).collect()


def test_query(spark, tool, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in K.op1_token_files(spark, sf_dir).collect()) == brute(tool, rows)
