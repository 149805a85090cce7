import hashlib

import duckdb
from pyspark.sql import functions as F

from spindrift.llm import lines as L


def brute(rows):
    """doc_id -> (lines, removed, text), straight from the definition."""
    seen, hit = set(), set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        own = [] if t is None else t.split("\n")
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            if not any(x.strip(" \t\r\v\f") for x in w):
                continue
            if w in seen:
                hit |= {(i, p), (i, p + 1), (i, p + 2)}
            seen.add(w)
    out = {}
    for i, t in rows:
        own = [] if t is None else t.split("\n")
        keep = [x for p, x in enumerate(own) if (i, p) not in hit]
        out[i] = (len(own), len(own) - len(keep), None if t is None else "\n".join(keep))
    return out


ROWS = [
    (4, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (7, None), (8, ""), (9, "a\nb"), (1, "r\nr\nr\nr\nr"), (3, "r\nr\nr"), (5, "\n\n\n\n"), (6, "\n\n\n\n q"),
    (10, "a\nb\nc"), (11, "l\n" * 30000), (12, "k\nl\nl\nl\nm"), (None, "a\nb\nc"),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, n_lines string")
    want = brute(ROWS)
    got = {r.doc_id: r for r in L.dedup_lines(docs, counts=("N_LINES", "gone")).collect()}
    assert {i: (r.N_LINES, r.gone, r.text) for i, r in got.items()} == want
    plain = L.dedup_lines(docs)
    assert plain.columns == docs.columns and plain.count() == len(ROWS) and L.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_change_alike(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(r.text for r in L.dedup_lines(docs).collect()) == ["a\nb\nc", "d", "d"]


def test_one_id_with_different_texts(spark):
    """Marks of one text don't reach another one with the same doc_id."""
    rows = [(1, "a\nb\nc\nd"), (2, "x\n" * 40 + "a\nb\nc"), (2, "y\nz"), (2, "a\nb\nc\nq"), (2, "one\ntwo\nthree\n" * 20), (3, "y\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, t): r.text for t, r in zip([t for _, t in rows], L.dedup_lines(docs.coalesce(1).withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect(), strict=True)}
    assert got[1, rows[0][1]] == rows[0][1] and got[2, "y\nz"] == got[3, "y\nz"] == "y\nz"
    assert got[2, rows[1][1]] == "x"
    assert got[2, "a\nb\nc\nq"] == "q"
    assert got[2, rows[4][1]] == "one\ntwo\nthree\n"


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("b", "1\n2\n3"), ("a", "1\n2\n3\n4"), (None, "1\n2\n3")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == {"a": "1\n2\n3\n4", "b": "", None: "1\n2\n3"}


def test_query(spark, sf_dir):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    got = sorted(tuple(r) for r in L.op4_line_dedup(spark, sf_dir).collect())
    assert got == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in duckdb.sql(L.ORACLE["op4_line_dedup"]).fetchall()) == got
