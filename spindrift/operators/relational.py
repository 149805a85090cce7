"""Queries on stored entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def in_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    return df.where(F.col("dataset_id") == dataset_id)


def latest_first(df: DataFrame, by: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(by).desc())


def entity_ids(persons: DataFrame, organizations: DataFrame) -> DataFrame:
    """id of every person and organization, once."""
    return persons.select(F.col("person_id").alias("id")).union(organizations.select("organization_id")).distinct()


def dangling(edges: DataFrame, ends: list[str], ids: DataFrame) -> DataFrame:
    """Rows of which an end is not among ids, with the name of that end.

    The rows stream past the ids, which are hashed: an end that most rows share is not sorted in one task.
    """
    ids = ids.hint("SHUFFLE_HASH")
    parts = [edges.join(ids, edges[e] == ids["id"], "left_anti").withColumn("dangling_end", F.lit(e)) for e in ends]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_entities(persons: DataFrame, organizations: DataFrame, query: str, limit: int = 25, literal: bool = False) -> DataFrame:
    """Persons, then organizations, whose name contains the query in any case; % and _ are wildcards unless literal."""
    hit = lambda c: F.lower(c).contains(query.lower()) if literal else c.ilike(f"%{query}%")
    p = persons.where(hit(F.col("name"))).select(F.col("person_id").alias("id"), "name", F.lit("Person").alias("type"), F.lit(0).alias("_rank"))
    o = organizations.where(hit(F.col("name"))).select(F.col("organization_id").alias("id"), "name", F.lit("Organization").alias("type"), F.lit(1).alias("_rank"))
    first = lambda df: df.orderBy("id").limit(limit)
    return first(p).unionByName(first(o)).orderBy("_rank", "id").limit(limit).select("id", "name", "type")


def count_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and record_count of all tables in one pass; empty tables count 0."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
        out = one if out is None else out.unionByName(one)
    return out


def overview(datasets: DataFrame) -> DataFrame:
    return datasets.agg(F.count("*").alias("dataset_count"), F.coalesce(F.sum(F.col("row_count").cast("long")), F.lit(0)).alias("total_rows"), F.avg("quality_score").alias("avg_quality"))


def event_types(events: DataFrame) -> DataFrame:
    return events.where("event_type IS NOT NULL").select("event_type").distinct().orderBy("event_type")


def date_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def timeline(events: DataFrame, first=None, last=None, kinds: list[str] | None = None) -> DataFrame:
    """Events in an inclusive range of dates and of some types (none given: all), by date."""
    if first is not None:
        events = events.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        events = events.where(F.col("date") <= F.lit(last).cast("date"))
    return (events.where(F.col("event_type").isin(kinds)) if kinds else events).orderBy("date", "event_id")


def events_on_map(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations with coordinates, their number of events (0 included) and marker size, most events first."""
    counts = events.where("location_id IS NOT NULL").groupBy("location_id").agg(F.count("*").alias("n"))
    there = locations.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    n = F.coalesce("n", F.lit(0))
    return there.join(counts, "location_id", "left").select("location_id", "city", "country", "latitude", "longitude", n.alias("event_count"), F.greatest(n, F.lit(1)).alias("marker_size")).orderBy(F.desc("event_count"), "location_id")


def mentions_by_label(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("label").agg(F.count("*").alias("mention_count")).orderBy(F.desc("mention_count"), "label")


def with_description(mentions: DataFrame, events: DataFrame, most: int = 80) -> DataFrame:
    """Mentions with the start of the text that they come from."""
    text = F.when(F.length("description") > most, F.concat(F.substring("description", 1, most), F.lit("..."))).otherwise(F.col("description"))
    return mentions.join(events.select(F.col("event_id").alias("source_id"), text.alias("description")), "source_id", "left")


def selector_labels(datasets: DataFrame) -> DataFrame:
    """One entry for each label; of equal ones the last created."""
    label = F.format_string("%s (%,d rows)", F.col("name"), F.col("row_count"))
    return datasets.groupBy(label.alias("label")).agg(F.max_by("dataset_id", F.struct("created_at", "dataset_id")).alias("dataset_id"))


def top_scores(scores: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """The best scores with their nodes' labels, to four digits."""
    best = scores.orderBy(F.desc("score"), "id").limit(n)
    return nodes.select("id", "label").join(F.broadcast(best), "id").select("id", "label", F.round("score", 4).alias("score"))


def counts_by_dataset(tables: dict[str, DataFrame]) -> DataFrame:
    """dataset_id, table_name, record_count of all data sets at once."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("dataset_id").agg(F.count("*").alias("record_count")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("dataset_id", "table_name", "record_count")
