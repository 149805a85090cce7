"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

from spindrift.plans import catalog
from spindrift.plans.experiments import experiment
from spindrift.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = ["map_event_counts", "entity_counts", "graph_edges", "degree_centrality", "top_degree", "pagerank_10_rounds", "connected_components", "quality_breakdown", "profile_summary", "anomalies_robust_z", "anomalies_isolation_forest", "er_multi_feature", "mentions_by_label"]


def timed(run, times: int) -> float:
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took), 3)


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or NAMES
    found = {}
    for name in wanted:
        run = lambda n=name: catalog.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()  # warm
        found[name] = timed(run, RUNS)
    quality, errors = {}, {}
    for size in () if sys.argv[1:] else map(int, filter(None, os.environ.get("BENCH_SIZES", "1000,10000").split(","))):
        try:
            got = experiment(spark, size, tempfile.mkdtemp())
        except Exception as e:  # the other figures still count
            errors[f"published_{size}"] = f"{type(e).__name__}: {str(e)[:300]}"
            continue
        for name, value in got.items():
            (found if name.endswith("_seconds") else quality)[f"published_{size}_{name.removesuffix('_seconds')}"] = value
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "quality": quality, "errors": errors, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
