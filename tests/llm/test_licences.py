import os

import duckdb
import pytest

from spindrift.llm import licences as L

MIT = L.KNOWN[0][1]


def test_rows(spark):
    texts = [
        "Copyright (c) 2020 Someone\n\n" + MIT, MIT.upper(), "  " + MIT.replace(" ", "\n\t ") + " !!", "// " + MIT.replace("\n", "\n// "),
        MIT + " And more.", None, "", "...", "Licenced under the APACHE Licence, version 2.0", "été", MIT.replace("sublicense", "sub-license"), "x " * 200000, MIT, MIT,
    ]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, LICENCE string")
    rows = sorted(L.scan_licences(docs).collect())
    assert [r.licence for r in rows] == ["MIT", "MIT", "MIT", "MIT", None, None, None, None, "Apache-2.0-notice", None, "MIT", None, "MIT", "MIT"]
    assert rows[5].digest == rows[6].digest == rows[7].digest != rows[9].digest
    assert L.scan_licences(docs.limit(0)).count() == 0 and L.scan_licences(docs, []).where("licence is not null").count() == 0
    own = spark.createDataFrame([("b", "Été!"), ("a", "été"), (None, "x"), ("c", None)], "licence string, text string")
    assert {r.doc_id: r.licence for r in L.scan_licences(docs.where("doc_id = 9"), own).collect()} == {9: "a"}


def test_copyright_line_and_spelling(spark):
    known = [("a", "the licence holder may organise"), ("b", "one\ntwo")]
    docs = spark.createDataFrame([(1, "The LICENSE-holder may organize."), (2, "one\n(C) 2001 me\nAll rights reserved.\ntwo"), (3, "one copyright me two")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in L.scan_licences(docs, known).collect()} == {1: "a", 2: "b", 3: None}


def test_adjacent_spellings(spark):
    """Every word of a run is replaced, though neighbours share the space between them; SQL agrees."""
    rows = [(1, "licence licence licence"), (2, "license LICENSE license"), (3, "sub-licence, sub licence per cent per cent"), (4, "sub licence sub license percent percent"), (5, "whilst whilst organisation")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.digest for r in L.scan_licences(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4]
    assert [r[0] for r in docs.orderBy("doc_id").select(L.canonical(docs["text"])).collect()][:2] == ["license license license"] * 2
    for i, t in rows:
        with duckdb.connect() as own:
            assert own.execute(f"SELECT sha256({L._sql_form(chr(116))}) FROM (SELECT ? AS t)", [t]).fetchall()[0][0] == got[i]


#: Names of the texts that Debian-like systems carry.
FILES = {"Artistic-1.0-Perl": "Artistic", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_long_licences(spark):
    """Whole texts as they are, in capitals, and as the comment of a source file."""
    texts = {}
    for name, _ in L.KNOWN_DIGESTS:
        with open(f"/usr/share/common-licenses/{FILES.get(name, name)}", encoding="utf-8", errors="replace") as f:
            texts[name] = f.read()
    rows = [(n, form(t)) for n, t in texts.items() for form in (str, str.upper, lambda t: "".join(f" * {x}\n" for x in t.split("\n")), lambda t: t[: len(t) // 2])]
    docs = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, name string, text string")
    for r in L.scan_licences(docs).collect():
        assert r.licence == (r.name if r.doc_id % 4 < 3 else None)


def test_query_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in L.op8_licences(spark, sf_dir).collect())
    assert got == sorted(duckdb.sql(L.ORACLE["op8_licences"]).fetchall())
