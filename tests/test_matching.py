import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import anomaly as A
from spindrift.operators import assistant as S
from spindrift.operators import evaluate as E
from spindrift.operators import extraction as N
from spindrift.operators import resolution as R


def people(spark, *names):
    return spark.createDataFrame([(str(i + 1), n) for i, n in enumerate(names)], "id string, name string")


def by_hand(names):
    """(i, j) -> weighted score of pairs of normalised names that share a block key, from the definitions."""
    grams = []
    for name in names:
        padded = [f" {w} " for w in name.split()]
        grams.append(Counter(w[i : i + k] for k in (2, 3) for w in padded for i in range(len(w) - k + 1)))
    df = Counter(g for own in grams for g in own)
    raw = [{g: c * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, c in own.items()} for own in grams]
    unit = [{g: x / math.sqrt(sum(y * y for y in own.values())) for g, x in own.items()} for own in raw]
    out = {}
    for i, a in enumerate(names):
        for j, b in list(enumerate(names))[i + 1 :]:
            if a[0] == b[0] or a.split()[-1] == b.split()[-1]:
                x, y = set(a.split()), set(b.split())
                cosine = sum(w * unit[j].get(g, 0.0) for g, w in unit[i].items())
                out[i, j] = 0.4 * SequenceMatcher(None, a, b).ratio() + 0.3 * len(x & y) / len(x | y) + 0.3 * cosine
    return out


def test_resolution(spark):
    base = {(r.id_a, r.id_b) for r in R.resolve(people(spark, "Nadia Okafor", "Nadia Okafor", "Viktor Hale"), "baseline", 0.5).collect()}
    assert ("1", "2") in base and ("1", "3") not in base
    names = ["nadia okafor", "n okafor", "nadja okafor", "ina petrova", "nils okafor berg", "irina petrova"]
    want = {(str(i + 1), str(j + 1)): round(s, 4) for (i, j), s in by_hand(names).items() if s >= 0.3}
    assert len(want) >= 4 and {(r.id_a, r.id_b): r.similarity for r in R.resolve(people(spark, *names), "multi_feature", 0.3).collect()} == want
    assert R.resolve(people(spark, "Nadia Okafor", "Viktor Hale")).count() == 0
    rows = R.resolve(people(spark, "Nadia Okafor", "Nadia Okafor", "Nadia Okafo", None, ""), threshold=0.3).collect()
    assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)
    assert not any(w in f"{r.confidence} {r.reason}".lower() for r in rows for w in ("same", "identical", "fraud"))
    with pytest.raises(ValueError):
        R.resolve(people(spark, "Nadia"), "no_such_method")


def test_comparison_of_methods(spark):
    own = people(spark, "Nadia Okafor", "Nadia Okafor", "Viktor Hale", "Viktor Hail", "Vera Holm")
    truth = spark.createDataFrame([("2", "1"), ("3", "5")], "id_a string, id_b string")
    got = {r.method: (r.precision, r.recall, r.f1_score) for r in R.compare_methods(own, truth, 0.95).collect()}
    assert got == {"baseline": (1.0, 0.5, 0.6667), "multi_feature": (1.0, 0.5, 0.6667)}


def test_labels(spark):
    got = [r[0] for r in spark.createDataFrame([(0.95,), (0.75,), (0.6,), (0.1,)], "s double").select(R.confidence_label(F.col("s"))).collect()]
    assert [x.split(" (")[0] for x in got] == ["Potential match", "Possible match", "Weak possible match", "Unlikely match"]


def test_small_blocks_are_not_starved(spark):
    names = [f"aaaaaaa zzzzzzz{i}" for i in range(200)] + ["bbbbbbb nnnnnnn", "cccccc nnnnnnn"]
    own = people(spark, *names)
    pairs = [tuple(r) for r in R.candidate_pairs(own, 50).collect()]
    assert ("201", "202") in pairs and len(pairs) == len(set(pairs)) <= 51 and len(pairs) > 20
    every = R.candidate_pairs(own).count()
    assert every == 200 * 199 // 2 + 1 == R.candidate_pairs(own, None).count()
    assert R.candidate_pairs(own, 1).count() < every and R.candidate_pairs(own.limit(0)).count() == 0


def test_evaluation(spark):
    pairs = lambda rows: E.pairs(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    r = E.evaluate(pairs([("2", "1"), ("3", "4"), ("4", "3")]), pairs([("1", "2"), ("5", "6")])).first()
    assert tuple(r) == (1, 1, 1, 0.5, 0.5, 0.5)
    none = E.evaluate(pairs([]), pairs([])).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "transaction_id string")
    ev = E.evaluate(ids("9", "3"), ids("9", "7"))
    assert ev.first().true_positives == 1 and E.false_positive_rate(ev, 12, 2).first()[0] == 0.1 and E.false_positive_rate(ev, 2, 2).first()[0] == 0.0


def moved(spark, amounts):
    return spark.createDataFrame([(f"{i:04d}", "a", "b", None if a is None else float(a), "2024-01-01") for i, a in enumerate(amounts)], "transaction_id string, source string, destination string, amount double, timestamp string")


def test_robust_z(spark):
    found = A.robust_z(moved(spark, [100.0, 105, 98, 102, 101, 99, 103, 97, 104, 50000])).collect()
    assert [r.transaction_id for r in found] == ["0009"] and "fraud" not in found[0].reason.lower()
    assert A.robust_z(moved(spark, [100.0] * 10)).count() == 0 and A.robust_z(moved(spark, [])).count() == 0
    two = A.robust_z(moved(spark, [100.0] * 9 + [10000.0, 20000.0, None]), 2.0).collect()
    assert [r.amount for r in two] == [20000.0, 10000.0]


@pytest.mark.parametrize("gathered", [50_000, 10])
def test_exact_quantile(spark, monkeypatch, gathered):
    monkeypatch.setattr(A, "GATHERED", gathered)
    rng = np.random.default_rng(0)
    for values in (rng.lognormal(0, 3, 401), rng.integers(0, 4, 400).astype(float), np.array([5.0]), np.array([1.0, 2.0]), np.full(50, 7.0)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
        assert A.exact_quantile(df, "v") == pytest.approx(np.median(values), rel=1e-12)
    assert A.exact_quantile(df.limit(0), "v") is None
    inf = float("inf")
    for values in ([inf] * 30 + [1.0, 2.0, 3.0] + [-inf] * 30, [inf] * 40 + [1.0], [5.0] * 20 + [7.0] * 21 + [inf] * 2, [1.7e308] * 15 + [-1.7e308] * 20 + [0.5] * 9):
        df = spark.createDataFrame([(x,) for x in values], "v double")
        assert A.exact_quantile(df, "v") == sorted(values)[(len(values) - 1) // 2] if len(values) % 2 else True
        found = A.robust_z(spark.createDataFrame([(str(i), x) for i, x in enumerate(values)], "transaction_id string, amount double"))
        assert found.where("isnan(anomaly_score)").count() == 0


def test_isolation_forest(spark):
    found = A.isolation_forest(moved(spark, [100.0 + i for i in range(50)] + [1_000_000.0]), 0.02).collect()
    assert [r.transaction_id for r in found] == ["0050"] and all(0 <= r.anomaly_score <= 1 for r in found)
    assert A.isolation_forest(moved(spark, [])).count() == 0 and A.isolation_forest(moved(spark, [5.0] * 20)).count() == 0


def test_extraction():
    assert [m[:2] for m in N.mentions_in("The ferry left Oslo on August 9, 2021.")] == [("August 9, 2021", "DATE"), ("Oslo", "PROPER_NOUN")]
    assert [m[0] for m in N.mentions_in("Rosa Lindqvist bought Harbor Mills.")] == ["Rosa Lindqvist", "Harbor Mills"]
    assert N.mentions_in("They were late.") == [] and N.mentions_in("") == [] and N.mentions_in(None) == []
    assert [m[1] for m in N.mentions_in("It rained on June 30, 2019.")] == ["DATE"]
    assert Counter(m[1] for m in N.mentions_in("In Oslo August 9, 2021 came 2021-10-03 and 3rd, 4 May 2020.")) == {"DATE": 3}


def test_extraction_of_tables(spark):
    df = spark.createDataFrame([("e1", "Rosa Lindqvist wrote to  Viktor Hale."), ("e2", ""), ("e3", None)], "id string, text string")
    rows = N.extract_for_texts(df, "id", "text").collect()
    assert {(r.source_id, r.entity_text) for r in rows} == {("e1", "Rosa Lindqvist"), ("e1", "Viktor Hale")}
    assert N.extract_for_texts(df, "id", "text", max_texts=0).count() == 0
    with pytest.raises(ValueError):
        N.extract(df, method="nonsense")
    own = N.extract(df, method="spacy", model=lambda t: [(t[:4], "PERSON", 0, 4), ("x", "MONEY", 0, 1)]).collect()
    assert [(r.entity_text, r.label, r.method) for r in own] == [("Rosa", "PERSON", "spacy")]
    if not N.model_available():
        with pytest.raises(RuntimeError):
            N.extract(df, method="spacy")
    s = df.select(N.split_sentences(F.lit("Rosa wrote. Was it late? Nobody knew! So it goes"))).first()[0]
    assert len(s) == 4 and df.select(N.split_sentences(F.lit(""))).first()[0] == []


@pytest.fixture(scope="module")
def data(spark):
    f = spark.createDataFrame
    return S.Dataset("demo", 10, {
        "persons": f([("p1", "Rosa Lindqvist", "o1"), ("p2", "Viktor Hale", "o1"), ("p3", "Lone Wolf", None)], "person_id string, name string, organization_id string"),
        "organizations": f([("o1", "Harbor Mills")], "organization_id string, name string"),
        "locations": f([], "location_id string, city string, country string"),
        "events": f([], "event_id string, event_type string, location_id string"),
        "relationships": f([("p1", "p2", "KNOWS", 0.9)], "source_entity string, target_entity string, relationship_type string, confidence double"),
        "transactions": f([(f"t{i}", "p1", "p2", a, None) for i, a in enumerate([100.0, 100.0, 95.0, 500000.0])], "transaction_id string, source string, destination string, amount double, timestamp timestamp"),
    }, 88.0)


@pytest.mark.parametrize(("question", "intent", "says"), [
    ("What is in here?", "overview", "demo holds 10 rows in all\n* persons: 3 rows"),
    ("Which are the most connections of Rosa Lindqvist?", "most_connected", "Rosa Lindqvist is linked directly to 2 entities\n* Among them: Harbor Mills, Viktor Hale"),
    ("Which are the strongest connections of Lone Wolf?", "most_connected", "nothing in the graph is linked to it"),
    ("Who is most central?", "most_connected", "Rosa Lindqvist has degree centrality"),
    ("Is there a path between Rosa Lindqvist and Viktor Hale or not", "shortest_path", "Rosa Lindqvist -> Viktor Hale: 1 hops"),
    ("Is there a path between Rosa Lindqvist or Lone Wolf", "shortest_path", "are not connected"),
    ("Is there a path between Zed and Yan?", "shortest_path", "does not name two entities"),
    ("List unusual payments", "anomalies", "500,000.00"),
    ("Show potential matches", "duplicates", "No two names are similar enough"),
    ("How clean are the tables?", "quality", "88 of 100"),
])
def test_answers(data, question, intent, says):
    r = S.answer(question, data).first()
    assert r.intent == intent and r.mode == "fallback" and says in r.answer and r.answer.startswith("FACT") and "fraud" not in r.answer.lower()


def test_explained_answers(data):
    ask = "How clean are the tables?"
    assert S.answer(ask, data, lambda p, q, e: f"{len(e)} facts").first().mode == "llm"
    assert S.answer(ask, data, lambda p, q, e: 1 / 0).first().mode == "fallback"
    assert S.plain_answer([]).startswith("UNCERTAINTY")
