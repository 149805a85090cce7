import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators import profile as P
from spindrift.sources import readers, store, synthetic
from spindrift.sources.xlsx import write_xlsx


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def col(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(fn(F.col("v"))).collect()]


def test_summary(spark):
    df = frame(spark, [("Alice", 30), ("Bob", 25), ("Alice", 30), (None, 40)], "name string, age int")
    s = P.summarize(df).first()
    assert (s.row_count, s.column_count, s.missing_value_pct, s.duplicate_row_count, s.duplicate_row_pct, s["columns"]) == (4, 2, 12.5, 1, 25.0, ["name", "age"])
    assert {r.column_name: r.missing_count for r in P.missing_by_column(df).collect()} == {"name": 1, "age": 0}
    e = P.summarize(df.limit(0)).first()
    assert (e.row_count, e.missing_value_pct, e.duplicate_row_pct) == (0, 0.0, 0.0)


def test_rows_are_told_apart(spark):
    """Nulls have a place, and maps, arrays and structs count."""
    rows = [(None, "a", 1.0, [1], {"x": 1}), ("a", None, 1.0, [1], {"x": 1}), (None, "a", -0.0, [], {}), (None, "a", 0.0, [], {}), (None, None, None, None, None), (None, None, None, None, None), ("", None, None, None, None)]
    df = frame(spark, rows, "a string, b string, c double, d array<int>, e map<string, int>")
    s = P.summarize(df).first()
    assert (s.row_count, s.duplicate_row_count, s.missing_value_pct) == (7, 2, round(100 * 18 / 35, 2))


def test_cleaning(spark):
    df = frame(spark, [("Alice", 30), ("Bob", 25), ("Alice", 30)], "name string, age int")
    assert P.clean(df).count() == 2
    r = P.clean_report(df).first()
    assert (r.original_row_count, r.cleaned_row_count, r.duplicate_rows_removed) == (3, 2, 1)
    w = frame(spark, [("  Alice  ",), ("Bob   Smith",), (None,)], "name string")
    assert {x.name for x in P.clean(w).collect()} == {"Alice", "Bob Smith", None}
    assert P.clean_report(w).first().whitespace_normalized_cells == 2
    twice = frame(spark, [("Alice",), ("Alice",)], "name string")
    assert P.clean(twice, drop_duplicates=False).count() == 2 and P.clean_report(twice, False).first().duplicate_rows_removed == 0


def test_normalisation(spark):
    assert col(spark, tx.normalize_string, ["  Mr. Muhammad Ali!  ", None, "Été à_b"]) == ["mr muhammad ali", "", "ete a_b"]
    assert col(spark, tx.strip_punctuation, ["M. Ali!", "été!"]) == ["M Ali", "été"]
    assert col(spark, tx.normalize_whitespace, ["Alice    Smith  ", "a\x1cb c"]) == ["Alice Smith", "a b c"]
    assert col(spark, tx.strip_accents, ["ﬁancé", "abc", None]) == ["fiance", "abc", None]


def test_validation(spark):
    df = frame(spark, [("Alice", 30)], "name string, age int")
    assert P.validate_schema(df, ["name", "age"]) == (True, [], [])
    assert P.validate_schema(df.select("name"), ["name", "age"])[2] == ["age"]
    assert not P.validate_schema(df.limit(0))[0]
    amounts = frame(spark, [("100",), ("abc",), ("50",)], "amount string")
    r = P.validate(amounts, rules={"amount": "numeric", "absent": "date", "x": "other"}).first()
    assert r.is_valid and r.invalid_value_count == 1 and r.invalid_value_pct == 33.33 and r.issues
    dates = frame(spark, [("2024-01-01",), ("not-a-date",), (None,)], "d string")
    assert [tuple(x) for x in P.invalid_values(dates, {"d": "date"}).collect()] == [("d", 2, 1)]
    odd = frame(spark, [("1.0d",), ("1f",), ("nan",), (" 1e5 ",), ("-.5",), ("inf",)], "n string")
    assert P.invalid_values(odd, {"n": "numeric"}).first().invalid_count == 3


@pytest.mark.parametrize(("rows", "schema", "rules", "want"), [
    ([("Alice", 30), ("Bob", 25)], "name string, age int", None, dict(completeness=100, uniqueness=100, validity=100, consistency=100, overall_score=100)),
    ([("Alice", 30), (None, 25)], "name string, age int", None, dict(completeness=75, overall_score=90)),
    ([("Alice", 30)] * 2, "name string, age int", None, dict(uniqueness=50)),
    ([("100",), ("abc",), ("50",), ("75",)], "amount string", {"amount": "numeric"}, dict(validity=75)),
    ([("30", "a"), ("twenty-five", "b"), ("40", "c"), ("35", "d")], "age string, name string", None, dict(consistency=50)),
    ([], "name string, age int", None, dict(overall_score=100)),
    ([(1.0, 2), (float("nan"), 3), (1.0, 2)], "a double, b int", None, dict(completeness=83.33, uniqueness=66.67)),
])
def test_quality(spark, rows, schema, rules, want):
    got = P.quality(frame(spark, rows, schema), rules).first()
    assert {k: got[k] for k in want} == want and len(got.explanation) == 4


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age,score,ok\nAlice,30,1.5,true\nBob,NA,2,False\n,7,n/a,true\n")
    df = readers.load(spark, f"{tmp_path}/a.csv")
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "double", "ok": "boolean"}
    assert df.where("name is null").first().age == 7
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": None}]))
    (tmp_path / "c.json").write_text(json.dumps({"records": [{"x": 1}, {"x": 2}, {"x": 3}]}))
    assert readers.load(spark, f"{tmp_path}/b.json").count() == 2 and readers.load(spark, f"{tmp_path}/c.json").columns == ["x"]
    write_xlsx(f"{tmp_path}/d.xlsx", ["name", "n", "flag"], [("A & B", 1, True), (None, 2, False), ("c", 3, None)])
    x = readers.load(spark, f"{tmp_path}/d.xlsx")
    assert dict(x.dtypes)["n"] == "bigint" and [r.name for r in x.orderBy("n").collect()] == ["A & B", None, "c"]
    with pytest.raises(FileNotFoundError):
        readers.load(spark, f"{tmp_path}/none.csv")
    with pytest.raises(ValueError):
        readers.load(spark, f"{tmp_path}/a.txt")
    _, summary = readers.load_with_summary(spark, f"{tmp_path}/a.csv")
    assert summary.first().row_count == 3 and summary.first().load_time_seconds > 0


def test_large_csv_files_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SPLIT_BYTES", 10)
    rows = [(i, f'say "{i}", twice', "x") for i in range(50)]
    frame(spark, rows, "n int, text string, c string").coalesce(1).write.csv(f"{tmp_path}/plain.csv", header=True, escape='"')
    frame(spark, [(i, f"{t}\nsecond line", c) for i, t, c in rows], "n int, text string, c string").coalesce(1).write.csv(f"{tmp_path}/breaks.csv", header=True, escape='"')
    assert not readers.quoted_line_breaks(spark, f"{tmp_path}/plain.csv") and readers.quoted_line_breaks(spark, f"{tmp_path}/breaks.csv")
    assert sorted(map(tuple, readers.load(spark, f"{tmp_path}/plain.csv").collect())) == rows
    assert [r.text for r in readers.load(spark, f"{tmp_path}/breaks.csv").orderBy("n").collect()] == [f"{t}\nsecond line" for _, t, _ in rows]


def test_a_failed_load_leaves_no_data_set(spark, tmp_path):
    tables = synthetic.generate(spark, 50)
    tables["transactions"] = tables["transactions"].withColumn("amount", F.lit("garbage"))
    synthetic.write_dataset(tables, str(tmp_path), 50)
    s = store.Store(spark, f"{tmp_path}/store")
    with pytest.raises(Exception, match="garbage"):
        s.load_dataset(str(tmp_path), 50)
    assert s.datasets().count() == 0


def test_settings_and_health(spark):
    from spindrift import settings

    own = settings.Settings.from_environment({"SPINDRIFT_APP_NAME": "mine", "SPINDRIFT_LOG_LEVEL": "debug", "OTHER": "x"})
    assert (own.app_name, own.log_level, own.environment, own.model) == ("mine", "debug", "development", None)
    assert settings.configure_logging(own.log_level).level == 10 and settings.configure_logging("nonsense").level == 20
    assert tuple(settings.health(spark, own).first()) == ("mine", "development", "ok")


def test_experiment(spark, tmp_path):
    from spindrift.plans import experiments

    got = experiments.experiment(spark, 100, str(tmp_path))
    assert got["nodes"] > 100 and 0 <= got["er_multi_feature_f1"] <= 1 and got["anomaly_statistical_recall"] in (0.0, 1.0) and not got["betweenness_approximated"]
    experiments.save(spark, [got], f"{tmp_path}/results")
    assert readers.load(spark, f"{tmp_path}/results/results.csv").count() == len(got) - 1


def test_synthetic_data_set_is_stored(spark, tmp_path):
    tables = synthetic.generate(spark, 200)
    again = synthetic.generate(spark, 200)
    assert tables["persons"].exceptAll(again["persons"]).isEmpty() and not tables["persons"].exceptAll(synthetic.generate(spark, 200, 7)["persons"]).isEmpty()
    synthetic.write_dataset(tables, str(tmp_path), 200)
    s = store.Store(spark, f"{tmp_path}/store")
    key = s.load_dataset(str(tmp_path), 200)
    row = s.dataset(key).first()
    n = {k: t.count() for k, t in s.entities(key).items()}
    assert row.row_count == sum(n.values()) and n["transactions"] == 200 and n["locations"] == 10 and 0 < row.quality_score <= 100
    assert s.entities(key)["events"].where("date is null or location_id is null").count() == 0
    assert s.entities(key)["relationships"].where("end_date is not null").count() == 0
    pairs, odd = store.true_pairs(spark, str(tmp_path), 200), store.true_anomalies(spark, str(tmp_path), 200)
    assert pairs.count() == n["persons"] - 200 and odd.count() == s.entities(key)["transactions"].where("amount >= 50000").count()
    assert store.true_pairs(spark, str(tmp_path), 999) is None
    from spindrift.operators.anomaly import robust_z

    run = s.record_anomalies(key, robust_z(s.entities(key)["transactions"]), {"z": 3.0})
    assert s.runs(key).first().finished_at is not None and s.anomalies(run).count() == odd.count()


def test_typed_cells(spark):
    df = frame(spark, [("t1", "a", "b", "5.5", "2020-01-01T00:10:00", "")], "transaction_id string, source string, destination string, amount string, timestamp string, location_id string")
    row = store.typed("transactions", df).first()
    assert row.amount == 5.5 and row.timestamp.minute == 10 and row.location_id is None
    with pytest.raises(Exception, match="without an amount"):
        store.typed("transactions", df.withColumn("amount", F.lit(""))).collect()


def test_whole_supplier_table_in_workbooks(spark, tmp_path):
    from spindrift.plans import catalog
    from spindrift.sources.xlsx import write_workbooks

    d = "/root/testdata/sf0.1"
    own = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    want = sorted((int(a), b, int(c)) for a, b, c in own.collect())
    assert len(want) > 10 and sorted(map(tuple, catalog.QUERIES["xlsx_roundtrip"](spark, d).collect())) == want
    paths = write_workbooks(own, f"{tmp_path}/many", 300)
    assert len(paths) == -(-len(want) // 300) and sorted(map(tuple, readers.load_workbooks(spark, paths).collect())) == want
    none = write_workbooks(own.limit(0), f"{tmp_path}/none")
    assert len(none) == 1 and readers.load_workbooks(spark, none).columns == own.columns
