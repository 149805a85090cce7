"""Potential anomalies among amounts: robust z-scores and an isolation forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Z_THRESHOLD = 3.0
CONTAMINATION = 0.01
MAD_SCALE = 1.4826
TREES = 100
SAMPLE = 256
#: Values that the search for an exact quantile hands to the driver at last, and bins of a round.
GATHERED = 50_000
BINS = 1024


def _at(values: np.ndarray, ends: np.ndarray, spot: float) -> float:
    """The value at a place among sorted values with running counts, interpolated between neighbours."""
    first, second = (float(values[np.searchsorted(ends, k, "right")]) for k in (math.floor(spot), math.ceil(spot)))
    return first if first == second else first + (second - first) * (spot % 1)


def _counted(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column v of few rows, sorted, and how many rows have up to each."""
    rows = sorted((r.v, r.c) for r in values.groupBy("v").agg(F.count("*").alias("c")).collect())
    return np.array([v for v, _ in rows]), np.cumsum([c for _, c in rows])


def _ranked(values: DataFrame, k: int, low: float, high: float) -> float:
    """The value of rank k of a column v that lies between two finite numbers.

    Each round counts bins in one aggregation and goes on in the bin of the rank, until it holds GATHERED rows at most or one value.
    """
    before, inside = 0, values
    while low < high:
        width = (high - low) / BINS or math.inf
        bins = sorted(tuple(r) for r in inside.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for _, count, a, b in bins:
            if before + count > k:
                low, high = a, b
                break
            before += count
        inside = values.where(F.col("v").between(low, high))
        if low < high and (count <= GATHERED or len(bins) == 1):
            found, ends = _counted(inside)
            return float(found[np.searchsorted(ends, k - before, "right")])
    return low


def exact_quantile(df: DataFrame, column: str, share: float = 0.5) -> float | None:
    """The exact quantile, interpolated between neighbours; null and NaN don't count, None if nothing else is there.

    Infinite values rank below and above all others. No task and not the driver ever holds more than GATHERED distinct values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    inf = float("inf")
    real = F.when((F.col("v") > -inf) & (F.col("v") < inf), F.col("v"))
    n, below, above, low, high = values.agg(F.count("*"), F.count(F.when(F.col("v") == -inf, 1)), F.count(F.when(F.col("v") == inf, 1)), F.min(real), F.max(real)).first()
    if not n:
        return None
    spot = share * (n - 1)
    if n <= GATHERED:
        return _at(*_counted(values), spot)
    finite = values.where(real.isNotNull())
    rank = lambda k: -inf if k < below else inf if k >= n - above else _ranked(finite, k - below, low, high)
    first = rank(math.floor(spot))
    second = rank(math.ceil(spot)) if spot % 1 else first
    return first if first == second else first + (second - first) * (spot % 1)


def _middle_and_spread(amounts: DataFrame) -> tuple[float, float] | None:
    """The median of a column `amount`, and the median distance from it; in one aggregation where the amounts are few."""
    own = amounts.select(F.col("amount").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    few = own.limit(GATHERED + 1).groupBy("v").agg(F.count("*").alias("c")).collect()
    n = sum(r.c for r in few)
    if not n:
        return None
    if n <= GATHERED:
        values, counts = np.array([r.v for r in few]), np.array([r.c for r in few])
        order = np.argsort(values)
        middle = _at(values[order], np.cumsum(counts[order]), 0.5 * (n - 1))
        with np.errstate(invalid="ignore"):  # equal infinities are no distance apart
            away = np.where(values == middle, 0.0, np.abs(values - middle))
        order = np.argsort(away)
        return middle, _at(away[order], np.cumsum(counts[order]), 0.5 * (n - 1))
    middle = exact_quantile(amounts, "amount")
    return middle, exact_quantile(amounts.select(F.abs(F.col("amount") - middle).alias("d")), "d")


def robust_z(transactions: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Transactions whose amount is at least `threshold` scaled median deviations from the median, farthest first; null amounts never.

    Keeps all columns and adds anomaly_score, method, reason. Where over half the amounts are equal, any other stands out. An infinite amount
    is infinitely far from a finite median; NaN is far from nothing.
    """
    own = transactions.withColumn("amount", F.col("amount").cast("double"))
    middle, mad = _middle_and_spread(own) or (0.0, 0.0)
    spread = mad * MAD_SCALE if mad > 0 else 1e-9
    z = F.abs((F.col("amount") - F.lit(middle)) / F.lit(spread))
    reason = F.format_string("%,.2f lies %.1f scaled median deviations off the median %,.2f", F.col("amount"), z, F.lit(middle))
    return own.where((z >= threshold) & ~F.isnan(z)).withColumns({"anomaly_score": F.round(z, 4), "method": F.lit("statistical"), "reason": reason}).orderBy(F.desc("anomaly_score"), "transaction_id")


def _expected(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(pool: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one feature a tree is a step function, and so is the forest: its cuts, mean depth in each step, and the sample's size."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    limit = math.ceil(math.log2(max(size, 2)))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        values = np.sort(rng.choice(pool, size, replace=False))
        cuts, depths = [], []

        def grow(own: np.ndarray, depth: int, cuts=cuts, depths=depths) -> None:
            if depth >= limit or len(own) < 2 or own[0] == own[-1]:
                depths.append(depth + _expected(len(own)))
                return
            at = rng.uniform(own[0], own[-1])
            k = int(np.searchsorted(own, at, "right"))
            grow(own[:k], depth + 1)
            cuts.append(at)
            grow(own[k:], depth + 1)

        grow(values, 0)
        steps.append((np.array(cuts), np.array(depths)))
    every = np.unique(np.concatenate([c for c, _ in steps]))
    total = np.zeros(len(every) + 1)
    inside = np.concatenate([every, [np.inf]])  # the right end of each step
    for cuts, depths in steps:
        total += depths[np.searchsorted(cuts, inside, "left")]
    return every, total / trees, size


def isolation_forest(transactions: DataFrame, contamination: float = CONTAMINATION, seed: int = 42) -> DataFrame:
    """The share `contamination` of transactions that a forest on log(1 + amount) isolates soonest, with scores from 0 to 1.

    The trees' samples come from a bounded pool: the TREES * SAMPLE amounts with the smallest hashes of their ids.
    """
    own = transactions.withColumn("amount", F.col("amount").cast("double")).where("amount IS NOT NULL AND amount > -1")
    feature = F.log1p("amount")
    total, wanted, h = own.count(), TREES * SAMPLE, F.pmod(F.xxhash64("transaction_id"), F.lit(1 << 40))
    few = own.where(h < int(1.5 * wanted / total * (1 << 40)) + 1) if total > 2 * wanted else own  # no task hands over more than its part
    pool = [r.f for r in few.orderBy(h, "transaction_id", "amount").limit(wanted).select(feature.alias("f")).collect()]
    if not pool:
        return own.withColumns({"anomaly_score": F.lit(0.0), "method": F.lit("isolation_forest"), "reason": F.lit("")}).limit(0)
    cuts, depth, size = grow_forest(np.array(pool), seed=seed)
    scores = 2.0 ** (-depth / max(_expected(size), 1e-9))

    @F.pandas_udf("double")
    def raw(values: pd.Series) -> pd.Series:
        return pd.Series(scores[np.searchsorted(cuts, values.to_numpy(), "left")])

    scored = own.withColumn("_raw", raw(feature))
    counts = sorted(((r._raw, r.c) for r in scored.groupBy("_raw").agg(F.count("*").alias("c")).collect()), reverse=True)  # as many as the forest has steps at most
    n = sum(c for _, c in counts)
    low, high = counts[-1][0], counts[0][0]
    spot, seen, limit = (1 - contamination) * (n - 1), 0, None
    ascending = counts[::-1]
    ranks = {}
    for wanted in (math.floor(spot), math.ceil(spot)):
        seen = 0
        for v, c in ascending:
            seen += c
            if seen > wanted:
                ranks[wanted] = v
                break
    limit = ranks[math.floor(spot)] + (ranks[math.ceil(spot)] - ranks[math.floor(spot)]) * (spot % 1)
    score = (F.col("_raw") - low) / ((high - low) or 1e-9)
    reason = F.format_string("%,.2f is cut off from the rest sooner than most amounts; score %.2f", F.col("amount"), score)
    found = scored.where(F.col("_raw") > F.lit(limit)).withColumns({"anomaly_score": F.round(score, 4), "method": F.lit("isolation_forest"), "reason": reason}).drop("_raw")
    return found.orderBy(F.desc("anomaly_score"), "transaction_id")
