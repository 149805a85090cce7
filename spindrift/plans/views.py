"""The driver's star-schema tables seen as entity tables, in DataFrames and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, d: str) -> DataFrame:
    own, n = table(spark, d, "customer"), table(spark, d, "nation")
    at = F.when(F.col("c_custkey") % 10 < 7, F.concat(F.lit("S"), (F.col("c_custkey") % 11 + 1).cast("string")))
    return own.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("person_id"), F.col("c_name").alias("name"), at.alias("organization_id"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("city"))


def organizations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("organization_id"), F.col("s_name").alias("name"))


def locations(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    none = F.col("n_nationkey") % 7 == 3
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("location_id"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.when(~none, F.col("n_nationkey") * 5.0 - 60).alias("latitude"), F.when(~none, F.col("n_nationkey") * 10.0 - 120).alias("longitude"))


def events(spark: SparkSession, d: str) -> DataFrame:
    e, c = table(spark, d, "events"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return e.join(c, e["user_id"] == c["c_custkey"], "left").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"), "event_type", F.col("ts").cast("date").alias("date"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("location_id"), F.concat_ws(" ", "event_type", F.lit("by customer"), F.col("user_id").cast("string"), F.lit("with"), "props").alias("description"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    return x.join(o.hint("SHUFFLE_HASH"), x["l_orderkey"] == o["o_orderkey"])


def relationships(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.min("l_returnflag") == "A", "ASSOCIATED_WITH").when(F.min("l_returnflag") == "N", "KNOWS").otherwise("PARTICIPATED_IN")
    pairs = trades(spark, d).groupBy("o_custkey", "l_suppkey").agg(kind.alias("relationship_type"), (1 - F.min("l_discount")).alias("confidence"))
    a, b = F.col("o_custkey").cast("string"), F.col("l_suppkey").cast("string")
    return pairs.select(F.concat(F.lit("R"), a, F.lit("-"), b).alias("relationship_id"), F.concat(F.lit("C"), a).alias("source_entity"), F.concat(F.lit("S"), b).alias("target_entity"), "relationship_type", "confidence")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", F.lit("T"), *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return trades(spark, d).select(key.alias("transaction_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("destination"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("timestamp"))


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """Event values, which have a heavy tail, as transactions."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("V"), F.col("event_id").cast("string")).alias("transaction_id"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("destination"), F.col("value").alias("amount"), F.col("ts").alias("timestamp"))


def entity_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f.__name__: f(spark, d) for f in (persons, organizations, locations, events, relationships, transactions)}


def full_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = entity_tables(spark, d)
    return graph.build_nodes(t["persons"], t["organizations"], t["locations"], t["events"]), graph.build_edges(*t.values())


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names as records to resolve."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.format_string("P%08d", F.min("p_partkey")).alias("id")).select("id", "name")


def order_notes(spark: SparkSession, d: str) -> DataFrame:
    """A sentence with names and a date for each order."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("event_id"), F.concat(F.lit("the buyer Rosa Lindqvist of "), F.initcap(F.lower("n_name")), F.lit(" ordered on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" from Harbor Mills.")).alias("description"))


SQL = """
WITH persons AS (SELECT 'C' || c_custkey AS person_id, c_name AS name, CASE WHEN c_custkey % 10 < 7 THEN 'S' || (c_custkey % 11 + 1) END AS organization_id, n_name AS country, c_mktsegment AS city FROM customer JOIN nation ON c_nationkey = n_nationkey),
organizations AS (SELECT 'S' || s_suppkey AS organization_id, s_name AS name FROM supplier),
locations AS (SELECT 'N' || n_nationkey AS location_id, n_name AS city, r_name AS country, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * CAST(5 AS DOUBLE) - 60 END AS latitude, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * CAST(10 AS DOUBLE) - 120 END AS longitude FROM nation JOIN region ON n_regionkey = r_regionkey),
evs AS (SELECT 'E' || event_id AS event_id, event_type, CAST(ts AS DATE) AS date, 'N' || c_nationkey AS location_id FROM events LEFT JOIN customer ON user_id = c_custkey),
trades AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
relationships AS (SELECT 'C' || o_custkey AS source_entity, 'S' || l_suppkey AS target_entity, CASE min(l_returnflag) WHEN 'A' THEN 'ASSOCIATED_WITH' WHEN 'N' THEN 'KNOWS' ELSE 'PARTICIPATED_IN' END AS relationship_type, 1 - min(l_discount) AS confidence FROM trades GROUP BY o_custkey, l_suppkey),
transactions AS (SELECT 'T-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id, 'C' || o_custkey AS source, 'S' || l_suppkey AS destination, l_extendedprice AS amount, l_shipdate AS timestamp FROM trades),
nodes AS (SELECT person_id AS id, 'Person' AS node_type, name AS label FROM persons UNION ALL SELECT organization_id, 'Organization', name FROM organizations UNION ALL SELECT location_id, 'Location', city || ', ' || country FROM locations UNION ALL SELECT event_id, 'Event', event_type FROM evs),
edges AS (SELECT person_id AS src, p.organization_id AS dst, 'WORKS_FOR' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM persons p JOIN organizations o ON p.organization_id = o.organization_id UNION ALL SELECT source_entity, target_entity, relationship_type, CASE WHEN confidence = 0 THEN 1 ELSE confidence END FROM relationships
  UNION ALL SELECT event_id, location_id, 'OCCURRED_AT', CAST(1 AS DOUBLE) FROM evs WHERE location_id IS NOT NULL UNION ALL SELECT source, destination, 'TRANSFERRED_TO', CAST(1 AS DOUBLE) FROM transactions),
pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)
"""
