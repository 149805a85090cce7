"""Stored tables of the engine."""

from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "date": DateType(), "timestamp": TimestampType()}


def _schema(text: str) -> StructType:
    """From `name type` pairs; unlike Spark's own parser it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (pair.split() for pair in text.split(","))])


TABLES = {
    "datasets": _schema("dataset_id string, name string, description string, row_count int, column_count int, missing_value_pct double, duplicate_row_pct double, quality_score double, created_at timestamp"),
    "data_sources": _schema("source_id string, dataset_id string, original_filename string, file_type string, ingested_at timestamp"),
    "organizations": _schema("organization_id string, name string, type string, country string, dataset_id string, created_at timestamp"),
    "persons": _schema("person_id string, name string, aliases string, organization_id string, country string, city string, dataset_id string, created_at timestamp"),
    "locations": _schema("location_id string, city string, country string, latitude double, longitude double, dataset_id string, created_at timestamp"),
    "events": _schema("event_id string, event_type string, date date, location_id string, description string, dataset_id string, created_at timestamp"),
    "relationships": _schema("relationship_id string, source_entity string, target_entity string, relationship_type string, start_date date, end_date date, confidence double, dataset_id string, created_at timestamp"),
    "transactions": _schema("transaction_id string, source string, destination string, amount double, timestamp timestamp, location_id string, dataset_id string, created_at timestamp"),
    "analysis_runs": _schema("run_id string, dataset_id string, run_type string, parameters string, started_at timestamp, finished_at timestamp"),
    "anomalies": _schema("anomaly_id string, run_id string, entity_type string, entity_id string, anomaly_score double, reason string, detected_at timestamp"),
}
ENTITIES = ("persons", "organizations", "locations", "events", "relationships", "transactions")
