"""Potential matches among records by blocking and multi-feature similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spindrift.functions.text import normalize_string, ratio_bound, sequence_ratio, token_jaccard, tokens
from spindrift.session import settle

MAX_CANDIDATE_PAIRS = 200_000
METHODS = ("baseline", "multi_feature")
# Bands of the confidence label, and the labels.
HIGH, MEDIUM, LOW = 0.85, 0.70, 0.55
BANDS = [(HIGH, "Potential match (high confidence)"), (MEDIUM, "Possible match (medium confidence)"), (LOW, "Weak possible match (low confidence)")]
UNLIKELY = "Unlikely match"
_STEP = 1_000_000_000_039  # a prime: its multiples visit each pair of a block at most once
_SALTS = 64


def blocking_keys(name: Column) -> Column:
    """First character and last word of a normalised name; none of an empty one."""
    return F.filter(F.array_distinct(F.array(F.substring(name, 1, 1), F.element_at(F.split(name, " "), -1))), lambda k: k != "")


def _ranked(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of large blocks with their rank: ranks within salted parts, plus the sizes of the parts before, so that no block is one task."""
    salted = keyed.join(sizes, "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    inner = salted.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id")) - 1)
    parts = salted.groupBy("key", "salt").agg(F.count("*").alias("c"))
    before = parts.withColumn("before", F.sum("c").over(Window.partitionBy("key").orderBy("salt")) - F.col("c")).drop("c")
    return inner.join(before, ["key", "salt"]).select("key", "id", (F.col("r") + F.col("before")).alias("rank"))


def candidate_pairs(records: DataFrame, max_pairs: int | None = MAX_CANDIDATE_PAIRS) -> DataFrame:
    """id_a < id_b of records (id, name: normalised) that share a block key.

    Each block may give max_pairs over the number of blocks of two or more, one at least. A larger block gives that many distinct
    pairs, numbered evenly over all of its pairs; they are computed from their numbers, so that a block's pairs are never all built.
    With max_pairs None nothing is left out: all pairs of all blocks come, from a join whose hot blocks AQE splits.
    """
    keyed = settle(records.select("id", F.explode(blocking_keys(F.col("name"))).alias("key")).distinct(), "keys")
    within = lambda own: own.join(own.select("key", F.col("id").alias("id_b")), "key").where(F.col("id") < F.col("id_b")).select(F.col("id").alias("id_a"), "id_b")
    if max_pairs is None:
        return within(keyed).distinct()
    sizes = Observation()
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("p", F.expr("n * (n - 1) div 2"))
    blocks = settle(counted.observe(sizes, F.count(F.lit(1)).alias("blocks"), F.max("p").alias("largest")), "blocks")
    budget = max(1, max_pairs // max(1, sizes.get["blocks"]))
    if (sizes.get["largest"] or 0) <= budget:
        return within(keyed).distinct()
    full = within(keyed.join(blocks.where(F.col("p") <= budget).select("key"), "key", "left_semi"))
    large = blocks.where(F.col("p") > budget)
    ranked = settle(_ranked(keyed, large.select("key")), "ranks")
    t = F.expr(f"pmod(pmod(k, p) * pmod({_STEP}, p) + pmod(xxhash64(key), p), p)")
    picks = large.select("key", "n", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(budget - 1).cast("long"))).alias("k")).withColumn("t", t)
    i = F.expr("n - 2 - CAST(floor((sqrt(CAST(-8 * t + 4 * n * (n - 1) - 7 AS DOUBLE)) - 1) / 2) AS BIGINT)")
    picks = picks.withColumn("i", i).withColumn("j", F.expr("t + i + 1 - p + (n - i) * (n - i - 1) div 2"))
    one = picks.join(ranked.select("key", F.col("rank").alias("i"), F.col("id").alias("x")), ["key", "i"])
    two = one.join(ranked.select("key", F.col("rank").alias("j"), F.col("id").alias("y")), ["key", "j"])
    some = two.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")
    return full.unionByName(some).distinct()


def _grams(name: Column) -> Column:
    """Runs of two and three characters of each word with a space on both sides."""
    padded = F.transform(tokens(name), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))))
    return F.concat(cut(2), cut(3))


def tfidf(records: DataFrame) -> DataFrame:
    """id, gram, w: counts times ln((1 + records) / (1 + records with the gram)) + 1, each record's vector of length one."""
    tf = records.select("id", F.explode(_grams(F.col("name"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    tf = settle(tf, "grams")
    df = settle(tf.groupBy("gram").agg(F.count("*").alias("df")), "document_counts")  # written, so that the join below stands on exchanges and a hot gram can be split
    n = records.agg(F.count("*").alias("n"))
    raw = tf.join(df, "gram").join(F.broadcast(n)).select("id", "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("v") / F.col("norm")).alias("w"))


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """id_a, id_b, cosine of pairs that share a gram."""
    a = weights.select(F.col("id").alias("id_a"), "gram", F.col("w").alias("wa"))
    b = weights.select(F.col("id").alias("id_b"), "gram", F.col("w").alias("wb"))
    return pairs.join(a, "id_a").join(b, ["id_b", "gram"]).groupBy("id_a", "id_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def confidence_label(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, label in BANDS[1:]:
        out = out.when(score >= least, label)
    return out.otherwise(UNLIKELY)


def resolve(records: DataFrame, method: str = "multi_feature", threshold: float = LOW, max_pairs: int | None = MAX_CANDIDATE_PAIRS) -> DataFrame:
    """Potential matches among (id, name), best first: both ids and names, similarity, confidence, reason.

    The record with the smaller id comes first in the sequence ratio. Null names match nothing. max_pairs bounds the pairs that are compared,
    as candidate_pairs() says; None compares all pairs of all blocks.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    own = settle(records.select("id", F.col("name").alias("original"), normalize_string(F.col("name")).alias("name")), "records")
    pairs = settle(candidate_pairs(own.select("id", "name"), max_pairs), "pairs")
    a = own.select(F.col("id").alias("id_a"), F.col("original").alias("name_a"), F.col("name").alias("na"))
    b = own.select(F.col("id").alias("id_b"), F.col("original").alias("name_b"), F.col("name").alias("nb"))
    rows = pairs.join(a, "id_a").join(b, "id_b")
    bound = ratio_bound(F.col("na"), F.col("nb"))
    if method == "baseline":
        scored = rows.where(bound >= threshold).withColumn("ratio", sequence_ratio("na", "nb")).withColumn("score", F.col("ratio"))
        reason = F.format_string("names alike by %.2f (longest common blocks)", "ratio")
    else:
        near = cosines(pairs, tfidf(own.select("id", "name")))
        rows = rows.join(near, ["id_a", "id_b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0))).withColumn("jaccard", token_jaccard(F.col("na"), F.col("nb")))
        rows = settle(rows.where(0.4 * bound + 0.3 * F.col("jaccard") + 0.3 * F.col("cosine") >= threshold - 1e-9), "features")
        scored = rows.withColumn("ratio", sequence_ratio("na", "nb")).withColumn("score", 0.4 * F.col("ratio") + 0.3 * F.col("jaccard") + 0.3 * F.col("cosine"))
        reason = F.format_string("longest common blocks %.2f, shared words %.2f, shared character runs %.2f; weighted %.2f", "ratio", "jaccard", "cosine", "score")
    kept = scored.where(F.col("score") >= threshold)
    return kept.select("id_a", "name_a", "id_b", "name_b", F.round("score", 4).alias("similarity"), confidence_label(F.col("score")).alias("confidence"), reason.alias("reason")).orderBy(F.desc("similarity"), "id_a", "id_b")


def compare_methods(records: DataFrame, truth: DataFrame, threshold: float = LOW) -> DataFrame:
    """method, precision, recall, f1_score of both methods against true pairs (id_a, id_b)."""
    from spindrift.operators.evaluate import evaluate, pairs

    out = None
    for method in METHODS:
        one = evaluate(pairs(resolve(records, method, threshold), "id_a", "id_b"), pairs(truth, "id_a", "id_b")).select(F.lit(method).alias("method"), "precision", "recall", "f1_score")
        out = one if out is None else out.unionByName(one)
    return out
