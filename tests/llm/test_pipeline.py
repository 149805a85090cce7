import hashlib

import corpus_pipeline as P
import pytest
from tokenizers import Tokenizer

from spindrift.llm import bpe, quality, simhash
from tests.llm.test_contamination import fast
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that each stage gets, and those that the last one returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400"), []
    for _, stage in P.STAGES:
        out.append(docs.collect())
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    return [*out, docs.collect()]


def test_stages_are_the_five():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding_decoding"]


def test_quality_drops_junk_and_keeps_clean(spark, steps):
    kept = {r.doc_id for r in steps[1]}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id < 400]
    bad, good = [r.doc_id in kept for r in labels if not r.quality], [r.doc_id in kept for r in labels if r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)
    assert {r for r in steps[1]} <= {r for r in steps[0]}


def test_lines(steps):
    want = brute_lines([(r.doc_id, r.text) for r in steps[1]])
    assert {r.doc_id: r.text for r in steps[2]} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_dedup(steps):
    sets = [(r.doc_id, frozenset(simhash.shingle_hashes(r.text.encode(), 5).tolist())) for r in steps[2]]
    want = brute_components(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    assert {r.doc_id for r in steps[3]} == {i for i, c in want.items() if i == c}


def test_decontamination(spark, steps):
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in steps[4]}
    for r in steps[3]:
        assert (r.doc_id in kept) == (fast(r.text.encode(), items)[1] == 0)


def test_bpe(steps):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in steps[4]}
    assert len(steps[5]) == len(texts)
    for r in steps[5]:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert quality.fit_quality is P.fit_quality
