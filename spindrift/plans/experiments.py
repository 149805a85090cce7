"""The published workload: load, graph, resolution and anomalies on a synthetic data set, with seconds and quality."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import anomaly, evaluate, graph, relational, resolution
from spindrift.session import settle
from spindrift.sources import store, synthetic

THRESHOLD = 0.70
DETECTORS = {"statistical": anomaly.robust_z, "isolation_forest": anomaly.isolation_forest}


def experiment(spark: SparkSession, size: int, folder: str) -> dict[str, float | int | bool]:
    """All figures for `size` persons, whose files and store lie below folder."""
    out: dict[str, float | int | bool] = {"size": size}

    def timed(name: str, run: Callable):
        start = time.perf_counter()
        got = run()
        out[f"{name}_seconds"] = round(time.perf_counter() - start, 3)
        return got

    synthetic.write_dataset(synthetic.generate(spark, size), folder, size)
    own = store.Store(spark, f"{folder}/store")
    key = timed("load", lambda: own.load_dataset(folder, size))
    t = own.entities(key)
    nodes = graph.build_nodes(t["persons"], t["organizations"], t["locations"], t["events"])
    edges = graph.build_edges(*(t[k] for k in ("persons", "organizations", "locations", "events", "relationships", "transactions")))
    out["nodes"], out["edges"] = timed("graph_build", lambda: (nodes.count(), edges.count()))
    metrics = timed("graph_metrics", lambda: graph.graph_metrics(nodes, edges).collect())
    out["betweenness_approximated"] = any(r.metric == "betweenness_approximated" and r.score for r in metrics)
    people = t["persons"].select(F.col("person_id").alias("id"), "name")
    truth = evaluate.pairs(store.true_pairs(spark, folder, size), "id_a", "id_b")
    for method in resolution.METHODS:
        found = timed(f"er_{method}", lambda m=method: settle(resolution.resolve(people, m, THRESHOLD), "matches"))
        r = evaluate.evaluate(evaluate.pairs(found, "id_a", "id_b"), truth).first()
        out |= {f"er_{method}_candidates": found.count(), f"er_{method}_precision": r.precision, f"er_{method}_recall": r.recall, f"er_{method}_f1": r.f1_score}
    odd, total = store.true_anomalies(spark, folder, size), t["transactions"].count()
    for name, detect in DETECTORS.items():
        found = timed(f"anomaly_{name}", lambda f=detect: settle(f(t["transactions"]).select("transaction_id"), "unusual"))
        scores = evaluate.evaluate(found, odd)
        r = scores.first()
        out |= {f"anomaly_{name}_precision": r.precision, f"anomaly_{name}_recall": r.recall, f"anomaly_{name}_f1": r.f1_score, f"anomaly_{name}_fpr": evaluate.false_positive_rate(scores, total, odd.count()).first()[0]}
    timed("simple_query", lambda: relational.count_entities(t).collect())
    out["driver_python_peak_mb"] = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
    return out


def as_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    """size, metric, value of several experiments."""
    rows = [(r["size"], name, float(value)) for r in results for name, value in r.items() if name != "size"]
    return spark.createDataFrame(rows, "size long, metric string, value double")


def save(spark: SparkSession, results: list[dict], folder: str) -> None:
    """The results as JSON and as CSV below folder."""
    table = as_table(spark, results).coalesce(1)
    store.write_json(table, f"{folder}/results.json")
    store.write_csv(table, f"{folder}/results.csv")
