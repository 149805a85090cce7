"""Typed tables in a folder: loading data sets, analysis runs, and plain writers."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.profile import quality, summarize
from spindrift.schemas import ENTITIES, TABLES
from spindrift.sources.readers import exists, load_csv, to_date, to_number, to_text, to_time


class Store:
    """Append-only Parquet tables below a folder; entity tables are partitioned by dataset_id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Columns that df lacks become null, created_at the time of writing."""
        now = F.current_timestamp()
        columns = [(df[f.name].cast(f.dataType) if f.name in df.columns else now if f.name in ("created_at", "ingested_at", "detected_at") else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[name].fields]
        writer = df.select(*columns).write.mode("append")
        (writer.partitionBy("dataset_id") if name in ENTITIES else writer).parquet(f"{self.folder}/{name}")

    def create_dataset(self, name: str, row_count: int, column_count: int, missing_value_pct: float = 0.0, duplicate_row_pct: float = 0.0, quality_score: float | None = None, description: str | None = None, dataset_id: str | None = None) -> str:
        dataset_id = dataset_id or str(uuid.uuid4())
        row = (dataset_id, name, description, row_count, column_count, missing_value_pct, duplicate_row_pct, quality_score, datetime.now(UTC))
        self.append("datasets", self.spark.createDataFrame([row], TABLES["datasets"]))
        return dataset_id

    def add_source(self, dataset_id: str, *filenames: str, file_type: str = "csv") -> None:
        rows = [(str(uuid.uuid4()), dataset_id, name, file_type, datetime.now(UTC)) for name in filenames]
        self.append("data_sources", self.spark.createDataFrame(rows, TABLES["data_sources"]))

    def dataset(self, dataset_id: str) -> DataFrame:
        return self.table("datasets").where(F.col("dataset_id") == dataset_id)

    def datasets(self) -> DataFrame:
        return self.table("datasets").orderBy(F.desc("created_at"))

    def entities(self, dataset_id: str) -> dict[str, DataFrame]:
        return {t: self.table(t).where(F.col("dataset_id") == dataset_id) for t in ENTITIES}

    def start_run(self, dataset_id: str, run_type: str, parameters: dict | None = None) -> str:
        run_id = str(uuid.uuid4())
        self.append("analysis_runs", self.spark.createDataFrame([(run_id, dataset_id, run_type, json.dumps(parameters or {}), datetime.now(UTC), None)], TABLES["analysis_runs"]))
        return run_id

    def finish_run(self, run_id: str) -> None:
        """Appends the finished record; the last one of a run counts."""
        row = self.runs().where(F.col("run_id") == run_id).withColumn("finished_at", F.current_timestamp())
        self.append("analysis_runs", self.spark.createDataFrame(row.collect(), TABLES["analysis_runs"]))

    def runs(self, dataset_id: str | None = None) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc_nulls_last("finished_at")))
        rows = self.table("analysis_runs").withColumn("_k", last).where("_k = 1").drop("_k")
        return (rows.where(F.col("dataset_id") == dataset_id) if dataset_id else rows).orderBy(F.desc("started_at"))

    def add_anomalies(self, run_id: str, found: DataFrame, entity_type: str = "transaction", entity_id: str = "transaction_id") -> None:
        rows = found.select(F.expr("uuid()").alias("anomaly_id"), F.lit(run_id).alias("run_id"), F.lit(entity_type).alias("entity_type"), F.col(entity_id).alias("entity_id"), "anomaly_score", "reason")
        self.append("anomalies", rows)

    def anomalies(self, run_id: str) -> DataFrame:
        return self.table("anomalies").where(F.col("run_id") == run_id)

    def record_anomalies(self, dataset_id: str, found: DataFrame, parameters: dict | None = None) -> str:
        """A run with its anomalies, finished once they are written."""
        run_id = self.start_run(dataset_id, "anomaly_detection", parameters)
        self.add_anomalies(run_id, found)
        self.finish_run(run_id)
        return run_id

    def load_dataset(self, folder: str, size: int | str, name: str | None = None) -> str:
        """The six CSV files `<table>_<size>.csv` of a folder, cast, stamped and stored; figures come from persons, as does the score.

        The tables are written side by side, each counted while it is written. The row in `datasets` comes last: a load that fails leaves no
        data set, and what it wrote carries an id that no data set has.
        """
        dataset_id = str(uuid.uuid4())
        raw = {t: load_csv(self.spark, f"{folder}/{t}_{size}.csv", strings=True) for t in ENTITIES}

        def put(t: str) -> int:
            seen = Observation()
            self.append(t, typed(t, raw[t]).withColumn("dataset_id", F.lit(dataset_id)).observe(seen, F.count(F.lit(1)).alias("n")))
            return seen.get["n"]

        with ThreadPoolExecutor(len(ENTITIES) + 2) as pool:
            person, score = pool.submit(lambda: summarize(raw["persons"]).first()), pool.submit(lambda: quality(raw["persons"]).first().overall_score)
            rows = sum(pool.map(put, ENTITIES))
            person, score = person.result(), score.result()
        self.add_source(dataset_id, *(f"{t}_{size}.csv" for t in ENTITIES))
        return self.create_dataset(name or f"synthetic_{size}", rows, person.column_count, person.missing_value_pct, person.duplicate_row_pct, score, f"scale={size}", dataset_id)


DATES = {"date", "start_date", "end_date"}
NUMBERS = {"latitude": None, "longitude": None, "amount": None, "confidence": 1.0}


def typed(table: str, df: DataFrame) -> DataFrame:
    """Text cells to the table's types: empty ones are null, an empty confidence is 1, an amount must be there."""
    out = []
    for f in TABLES[table].fields:
        if f.name not in df.columns:
            continue
        c = df[f.name]
        if f.name in NUMBERS:
            cast = to_number(c, NUMBERS[f.name])
            if f.name == "amount":
                cast = F.coalesce(cast, F.raise_error(F.lit("a transaction without an amount")).cast("double"))
        else:
            cast = to_date(c) if f.name in DATES else to_time(c) if f.name == "timestamp" else to_text(c)
        out.append(cast.alias(f.name))
    return df.select(*out)


def true_pairs(spark: SparkSession, folder: str, size: int | str) -> DataFrame | None:
    """id_a, id_b of records that are known to be one person; None without the file."""
    path = f"{folder}/ground_truth_entity_resolution_{size}.csv"
    if not exists(spark, path):
        return None
    df = load_csv(spark, path, strings=True)
    if "person_id" not in df.columns:
        return spark.createDataFrame([], "id_a string, id_b string")
    return df.select(F.least("person_id", "true_identity_id").alias("id_a"), F.greatest("person_id", "true_identity_id").alias("id_b")).distinct()


def true_anomalies(spark: SparkSession, folder: str, size: int | str) -> DataFrame | None:
    """transaction_id of the amounts that were put in; None without the file."""
    path = f"{folder}/ground_truth_anomalies_{size}.csv"
    if not exists(spark, path):
        return None
    df = load_csv(spark, path, strings=True)
    return df.select("transaction_id").distinct() if "transaction_id" in df.columns else spark.createDataFrame([], "transaction_id string")


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression=compression, timestampFormat="yyyy-MM-dd'T'HH:mm:ss", emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
