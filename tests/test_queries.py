"""Registered queries against their SQL, and that the rest lives without the training-data operators."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from spindrift.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    other = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(other.columns)
    order = [other.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in order) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - {"graph_metrics", "betweenness_top"}))
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def test_pages_name_queries():
    assert len(catalog.PAGES) == 11 and {q for own in catalog.PAGES.values() for q in own} <= set(catalog.QUERIES)


def test_entry_hides_no_other_import_error():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['spindrift.settings'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode


def test_entry_without_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['spindrift.llm'] = None; import __spark_entry__ as e; assert 'map_event_counts' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
