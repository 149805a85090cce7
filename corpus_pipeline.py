"""From raw documents to token ids; each stage works on what its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.bpe import bpe_digests
from spindrift.llm.contamination import decontaminate
from spindrift.llm.lines import dedup_lines
from spindrift.llm.quality import fit_quality, held_out, keep_quality
from spindrift.llm.shared import materialize
from spindrift.llm.simhash import drop_near_copies
from spindrift.session import ship


def _stage(f):
    """The stage, with the package within the workers' reach."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that op5 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return keep_quality(docs, fit_quality(docs, labels))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; all documents stay, and n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share at least 0.8 of their five-word shingles, in chains, the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of thirteen words of a benchmark item, or a whole shorter one, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text that they decode to.

    The workers, which serve other stages too, remember fewer words than where they do nothing else.
    """
    return bpe_digests(docs.select("doc_id", "lang", "source", "text"), ids="ids", remembered=120_000).drop("text")


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("bpe_encoding_decoding", bpe)]

#: SQL cannot express the trained classifier and the BPE merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
