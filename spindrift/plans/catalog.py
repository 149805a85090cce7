"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import settings
from spindrift.functions import text as tx
from spindrift.operators import anomaly, assistant, evaluate, extraction, graph, profile, relational, resolution
from spindrift.plans import views as v
from spindrift.session import shared_folder
from spindrift.sources import readers, store, synthetic

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False):
    """Registers a function under its name, with its SQL; `views` puts the entity tables in front."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"{v.SQL.rstrip()}\n{sql}" if views else sql
        return f

    return add


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text with gaps, garbage and repeated rows."""
    o = v.table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.when(key % 5 != 0, F.col("o_orderstatus")).alias("status"), F.when(key % 7 == 0, F.lit("n.a.")).when(key % 11 != 0, F.floor("o_totalprice").cast("string")).alias("price"),
        F.when(key % 13 == 0, F.lit("someday")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), (F.col("o_custkey") % 20).cast("string").alias("group"),
    )


_DIRTY = """WITH t AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'n.a.' WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
CASE WHEN o_orderkey % 13 = 0 THEN 'someday' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CAST(o_custkey % 20 AS VARCHAR) AS "group" FROM orders)
"""
_NUMBER = r"regexp_matches(price, '^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$')"
RULES = {"price": "numeric", "day": "date"}


@query(_DIRTY + """SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, round(100.0 * CAST(sum((status IS NULL)::INT + (price IS NULL)::INT + (day IS NULL)::INT) AS BIGINT) / (count(*) * 4), 2) AS missing_value_pct,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_row_count, round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / count(*), 2) AS duplicate_row_pct FROM t""")
def profile_summary(spark, d):
    return profile.summarize(_dirty(spark, d)).drop("columns", "dtypes")


@query(_DIRTY + "SELECT 'status' AS column_name, count(*) - count(status) AS missing_count FROM t UNION ALL SELECT 'price', count(*) - count(price) FROM t UNION ALL SELECT 'day', count(*) - count(day) FROM t UNION ALL SELECT 'group', count(*) - count(\"group\") FROM t")
def profile_missing_by_column(spark, d):
    return profile.missing_by_column(_dirty(spark, d))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10")
def preview_head(spark, d):
    return profile.preview(v.table(spark, d, "customer"), ["c_custkey"], 10)


@query(_DIRTY + "SELECT 'price' AS column_name, count(price) AS checked, count(*) FILTER (WHERE price IS NOT NULL AND NOT " + _NUMBER + ") AS invalid_count FROM t UNION ALL SELECT 'day', count(day), count(*) FILTER (WHERE day IS NOT NULL AND try_cast(day AS DATE) IS NULL) FROM t")
def invalid_value_counts(spark, d):
    return profile.invalid_values(_dirty(spark, d), RULES)


@query(_DIRTY + "SELECT FALSE AS is_valid, 'required columns are absent: owner' AS issue, 'owner' AS missing_required, CAST(x AS BIGINT) AS invalid_value_count, round(100.0 * x / n, 2) AS invalid_value_pct FROM (SELECT count(price) + count(day) AS n, count(*) FILTER (WHERE price IS NOT NULL AND NOT " + _NUMBER + ") + count(*) FILTER (WHERE day = 'someday') AS x FROM t)")
def validation_report(spark, d):
    r = profile.validate(_dirty(spark, d), ["status", "owner"], RULES)
    return r.select("is_valid", F.element_at("issues", 1).alias("issue"), F.array_join("missing_required_columns", ",").alias("missing_required"), "invalid_value_count", "invalid_value_pct")


@query(_DIRTY + ", f AS (SELECT count(*) AS n, count(*) * 4 AS cells, count(*) * 3 - count(status) - count(price) - count(day) AS gaps, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS kinds, count(price) + count(day) AS checked, count(*) FILTER (WHERE price IS NOT NULL AND NOT " + _NUMBER + ") + count(*) FILTER (WHERE day = 'someday') AS bad FROM t), m AS (SELECT 1 - gaps / cells AS a, 1 - (n - kinds) / n AS b, 1 - bad / checked AS c, 1 - 1 / 4 AS e FROM f) SELECT round(a * 100, 2) AS completeness, round(b * 100, 2) AS uniqueness, round(c * 100, 2) AS validity, round(e * 100, 2) AS consistency, round((a * 0.40::DOUBLE + b * 0.25::DOUBLE + c * 0.20::DOUBLE + e * 0.15::DOUBLE) * 100, 2) AS overall_score FROM m")
def quality_breakdown(spark, d):
    return profile.quality(_dirty(spark, d), RULES).drop("explanation")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v\x1c-\x1f]+', ' ', 'g'), ' ') AS cleaned FROM documents")
def clean_whitespace_documents(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("cleaned"))


def _messy(spark, d):
    return v.table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(""), F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("\t ")))).alias("name"), "p_brand", F.col("p_size").alias("size"))


_MESSY = "WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE '' END || replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE chr(9) || ' ' END) AS name, p_brand, p_size AS size FROM part), c AS (SELECT trim(regexp_replace(name, '[ \\t]+', ' ', 'g'), ' ') AS name, p_brand, size, name AS old FROM t)\n"


@query(_MESSY + "SELECT count(*) AS original_row_count, (SELECT count(*) FROM (SELECT DISTINCT name, p_brand, size FROM c)) AS cleaned_row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, p_brand, size FROM c)) AS duplicate_rows_removed, count(*) FILTER (WHERE old <> name) AS whitespace_normalized_cells FROM c")
def clean_report(spark, d):
    return profile.clean_report(_messy(spark, d))


@query(_MESSY + "SELECT DISTINCT name, p_brand, size FROM c")
def clean_parts(spark, d):
    return profile.clean(_messy(spark, d))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS name FROM customer")
def normalize_names(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", tx.normalize_string(F.col("c_name")).alias("name"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\pL\pM\pN_\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS normalized FROM documents")
def normalize_accents_documents(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.normalize_string(F.col("text")).alias("normalized"))


@query("SELECT dangling_end, count(*) AS n FROM (SELECT 'source' AS dangling_end FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'destination' FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1")
def dangling_edges(spark, d):
    o = v.table(spark, d, "orders")
    edges = o.select(F.concat(F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise("C"), F.col("o_custkey").cast("string")).alias("source"), F.when(F.col("o_orderkey") % 4 == 0, "nobody").otherwise("S1").alias("destination"))
    ids = relational.entity_ids(v.persons(spark, d), v.organizations(spark, d))
    return relational.dangling(edges, ["source", "destination"], ids).groupBy("dangling_end").agg(F.count("*").alias("n"))


@query("SELECT person_id AS id FROM persons UNION SELECT organization_id FROM organizations", True)
def valid_entity_ids(spark, d):
    return relational.entity_ids(v.persons(spark, d), v.organizations(spark, d))


@query("SELECT id, name, type FROM (SELECT * FROM (SELECT person_id AS id, name, 'Person' AS type, 0 AS r FROM persons WHERE name ILIKE '%_0001%' ORDER BY id LIMIT 25) UNION ALL SELECT * FROM (SELECT organization_id, name, 'Organization', 1 FROM organizations WHERE name ILIKE '%_0001%' ORDER BY 1 LIMIT 25)) ORDER BY r, id LIMIT 25", True)
def search_entities(spark, d):
    return relational.search_entities(v.persons(spark, d), v.organizations(spark, d), "_0001")


@query("SELECT 'persons' AS table_name, count(*) AS record_count FROM persons UNION ALL SELECT 'organizations', count(*) FROM organizations UNION ALL SELECT 'locations', count(*) FROM locations UNION ALL SELECT 'events', count(*) FROM evs UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'transactions', count(*) FROM transactions", True)
def entity_counts(spark, d):
    return relational.count_entities(v.entity_tables(spark, d))


def _datasets(spark, d):
    c = v.table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.count("*").cast("int").alias("row_count"), F.min("c_custkey").alias("k")).select(F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.concat(F.lit("nation "), (F.col("c_nationkey") % 20).cast("string")).alias("name"), "row_count", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey") * 4.0).alias("quality_score"), F.timestamp_seconds(F.col("k")).alias("created_at"))


_DATASETS = "WITH ds AS (SELECT 'D' || c_nationkey AS dataset_id, 'nation ' || (c_nationkey % 20) AS name, count(*) AS row_count, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey * CAST(4 AS DOUBLE) END AS quality_score, min(c_custkey) AS k FROM customer GROUP BY c_nationkey)\n"


@query(_DATASETS + "SELECT count(*) AS dataset_count, CAST(sum(row_count) AS BIGINT) AS total_rows, avg(quality_score) AS avg_quality FROM ds")
def overview_kpis(spark, d):
    return relational.overview(_datasets(spark, d))


@query(_DATASETS + "SELECT dataset_id, name, k FROM ds ORDER BY k DESC LIMIT 5")
def datasets_latest_first(spark, d):
    return relational.latest_first(_datasets(spark, d)).limit(5).select("dataset_id", "name", F.unix_seconds("created_at").alias("k"))


@query(_DATASETS + "SELECT name || ' (' || row_count || ' rows)' AS label, arg_max(dataset_id, k) AS dataset_id FROM ds GROUP BY 1")
def selector_labels(spark, d):
    return relational.selector_labels(_datasets(spark, d)).withColumn("label", F.replace("label", F.lit(","), F.lit("")))


@query(_DATASETS + "SELECT dataset_id, name, CAST(row_count AS INTEGER) AS row_count FROM ds WHERE dataset_id = 'D7'")
def dataset_by_id(spark, d):
    return relational.get(_datasets(spark, d), "dataset_id", "D7").select("dataset_id", "name", "row_count")


@query("SELECT DISTINCT event_type FROM events")
def event_types(spark, d):
    return relational.event_types(v.events(spark, d))


@query("SELECT min(CAST(ts AS DATE)) AS min_date, max(CAST(ts AS DATE)) AS max_date FROM events")
def event_date_range(spark, d):
    return relational.date_range(v.events(spark, d))


@query("SELECT 'E' || event_id AS event_id, event_type, CAST(ts AS DATE) AS date FROM events, (SELECT min(CAST(ts AS DATE)) AS lo FROM events) WHERE CAST(ts AS DATE) BETWEEN lo + 2 AND lo + 9 AND event_type IN ('click', 'error', 'purchase')")
def timeline_filter(spark, d):
    e = v.events(spark, d)
    lo = relational.date_range(v.table(spark, d, "events").select(F.col("ts").cast("date").alias("date"))).first().min_date
    return relational.timeline(e, F.date_add(F.lit(lo), 2), F.date_add(F.lit(lo), 9), ["click", "error", "purchase"]).select("event_id", "event_type", "date")


@query("SELECT l.location_id, city, country, latitude, longitude, coalesce(n, 0) AS event_count, greatest(coalesce(n, 0), 1) AS marker_size FROM locations l LEFT JOIN (SELECT location_id, count(*) AS n FROM evs GROUP BY 1) e ON l.location_id = e.location_id WHERE latitude IS NOT NULL", True)
def map_event_counts(spark, d):
    return relational.events_on_map(v.events(spark, d), v.locations(spark, d))


@query("SELECT id, node_type, label FROM nodes", True)
def graph_nodes(spark, d):
    return v.full_graph(spark, d)[0]


@query("SELECT edge_type, count(*) AS n, round(sum(weight), 4) AS w, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY edge_type", True)
def graph_edges(spark, d):
    return v.full_graph(spark, d)[1].groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("w"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("SELECT DISTINCT edge_type FROM edges", True)
def edge_types(spark, d):
    return graph.edge_types(v.full_graph(spark, d)[1])


@query("SELECT n AS node_count, m AS edge_count, round(m / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM edges)", True)
def graph_density(spark, d):
    return graph.size_and_density(*v.full_graph(spark, d))


@query("SELECT id, coalesce(k, 0) AS degree, round(coalesce(k, 0) / ((SELECT count(*) FROM nodes) - 1), 8) AS score FROM nodes LEFT JOIN (SELECT id AS i, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) ON id = i", True)
def degree_centrality(spark, d):
    return graph.degree_centrality(*v.full_graph(spark, d)).select("id", "degree", F.round("score", 8).alias("score"))


@query("SELECT id, label, score FROM (SELECT id, label, round(coalesce(k, 0) / ((SELECT count(*) FROM nodes) - 1), 4) AS score, coalesce(k, 0) AS k FROM nodes LEFT JOIN (SELECT id AS i, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) ON id = i) ORDER BY k DESC, id LIMIT 10", True)
def top_degree(spark, d):
    nodes, edges = v.full_graph(spark, d)
    return relational.top_scores(graph.degree_centrality(nodes, edges), nodes)


#: Rounds of labels in SQL; the graph's paths are shorter.
_LABEL_ROUNDS = 10
_COMPONENTS = ", c0 AS MATERIALIZED (SELECT id, id AS m FROM nodes)" + "".join(f", c{i + 1} AS MATERIALIZED (SELECT c.id, least(c.m, coalesce(n.m, c.m)) AS m FROM c{i} c LEFT JOIN (SELECT src, min(o.m) AS m FROM pairs JOIN c{i} o ON o.id = dst GROUP BY 1) n ON n.src = c.id)" for i in range(_LABEL_ROUNDS))


@query(_COMPONENTS + f" SELECT id, m AS component FROM c{_LABEL_ROUNDS}", True)
def connected_components(spark, d):
    return graph.components(*v.full_graph(spark, d))


def _ranks(rounds: int) -> str:
    """SQL of the PageRank scores r0, r1, ... of so many rounds."""
    one = lambda i: f", r{i + 1} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f, 0) + lost / n) AS s FROM nodes LEFT JOIN (SELECT dst, sum(p * s) AS f FROM l JOIN r{i} ON l.src = r{i}.id GROUP BY 1) ON id = dst, c, (SELECT coalesce(sum(s), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM o)))"
    return ", w AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY 1, 2), o AS MATERIALIZED (SELECT src, sum(w) AS o FROM w GROUP BY 1), l AS MATERIALIZED (SELECT w.src, dst, w / o AS p FROM w JOIN o ON w.src = o.src), c AS MATERIALIZED (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS s FROM nodes, c)" + "".join(map(one, range(rounds)))


@query(_ranks(10) + " SELECT id, round(s, 9) AS score FROM r10", True)
def pagerank_10_rounds(spark, d):
    return graph.pagerank(*v.full_graph(spark, d), fixed=10).select("id", F.round("score", 9).alias("score"))


#: Rounds in SQL, of which the first that moves little enough counts.
_STOP_ROUNDS = 40


@query(_ranks(_STOP_ROUNDS) + ", e AS (" + " UNION ALL ".join(f"SELECT {i} AS k, sum(abs(a.s - b.s)) AS moved FROM r{i} a JOIN r{i - 1} b ON a.id = b.id" for i in range(1, _STOP_ROUNDS + 1)) + "), stop AS (SELECT min(k) AS k FROM e, c WHERE moved < n * 1e-6::DOUBLE) SELECT id, round(s, 9) AS score FROM (" + " UNION ALL ".join(f"SELECT {i} AS k, id, s FROM r{i}" for i in range(1, _STOP_ROUNDS + 1)) + ") WHERE k = (SELECT k FROM stop) ORDER BY s DESC, id LIMIT 10", True)
def pagerank_top(spark, d):
    return graph.top_n(graph.pagerank(*v.full_graph(spark, d))).select("id", F.round("score", 9).alias("score"))


@query()
def betweenness_top(spark, d):
    nodes, edges = v.full_graph(spark, d)
    both = edges.select(F.inline(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))))
    return graph.top_n(graph.betweenness(nodes, both))


@query()
def betweenness_sampled(spark, d):
    return graph.betweenness(*v.full_graph(spark, d), exact_nodes=0, sources=50).select("id", F.round("score", 9).alias("score"), "approximated")


@query()
def communities(spark, d):
    nodes, edges = v.full_graph(spark, d)
    found = graph.communities(nodes, edges)
    return nodes.sparkSession.createDataFrame([], "community long, id string") if found is None else found


@query(", h1 AS MATERIALIZED (SELECT DISTINCT dst AS id FROM pairs WHERE src = 'C1'), h2 AS MATERIALIZED (SELECT DISTINCT dst AS id FROM pairs WHERE src IN (SELECT id FROM h1) AND dst <> 'C1' AND dst NOT IN (SELECT id FROM h1)), k AS (SELECT 'C1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 ORDER BY hop, id LIMIT 300) SELECT n.id, node_type, label, hop FROM nodes n JOIN k ON n.id = k.id", True)
def neighborhood_k2(spark, d):
    return graph.neighborhood(*v.full_graph(spark, d), "C1", 2)[0]


@query(", h1 AS (SELECT DISTINCT dst AS id FROM (SELECT src, dst FROM edges WHERE edge_type = 'KNOWS' UNION ALL SELECT dst, src FROM edges WHERE edge_type = 'KNOWS') WHERE src = 'S1'), k AS (SELECT 'S1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 ORDER BY hop, id LIMIT 300) SELECT src, dst, edge_type, weight FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)", True)
def neighborhood_edges_filtered(spark, d):
    return graph.neighborhood(*v.full_graph(spark, d), "S1", 1, ["KNOWS"])[1].select("src", "dst", "edge_type", "weight")


@query(" SELECT CAST(min(h) AS BIGINT) AS hops FROM (SELECT 1 AS h FROM pairs WHERE src = 'C1' AND dst = 'C2' UNION ALL SELECT 2 FROM pairs a JOIN pairs b ON a.dst = b.src WHERE a.src = 'C1' AND b.dst = 'C2' UNION ALL SELECT 4 FROM (SELECT DISTINCT c.dst AS x FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src WHERE a.src = 'C1') JOIN pairs e ON e.src = x WHERE e.dst = 'C2')", True)
def shortest_path_hops(spark, d):
    return graph.render_path(graph.shortest_path(*v.full_graph(spark, d), "C1", "C2")).select("hops")


@query("SELECT id, node_type, label FROM nodes WHERE lower(label) LIKE '%01%' ORDER BY CASE node_type WHEN 'Person' THEN 0 WHEN 'Organization' THEN 1 WHEN 'Location' THEN 2 ELSE 3 END, id LIMIT 25", True)
def search_nodes(spark, d):
    return graph.search_nodes(v.full_graph(spark, d)[0], " 01 ")


@query("SELECT DISTINCT n.id, label FROM nodes n JOIN (SELECT dst AS id FROM edges WHERE src = 'C3' UNION SELECT src FROM edges WHERE dst = 'C3') e ON n.id = e.id", True)
def neighbors_of_entity(spark, d):
    return graph.neighbors(*v.full_graph(spark, d), "C3")


@query("SELECT id, substr(label, 1, 40) AS label, 'node_type: ' || node_type || chr(10) || 'label: ' || label AS title, CASE node_type WHEN 'Person' THEN '#4C78A8' WHEN 'Organization' THEN '#F58518' WHEN 'Location' THEN '#54A24B' ELSE '#B279A2' END AS color, CASE WHEN id = 'C1' THEN 20 ELSE 12 END AS size, CASE WHEN id = 'C1' THEN 3 ELSE 1 END AS border_width FROM nodes", True)
def node_styles(spark, d):
    return graph.node_styles(v.full_graph(spark, d)[0], "C1")


@query("SELECT src, dst, edge_type AS label, edge_type AS title, 'to' AS arrows FROM edges", True)
def edge_styles(spark, d):
    return graph.edge_styles(v.full_graph(spark, d)[1])


_KEYS = "names AS (SELECT 'P' || lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') AS id, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name FROM part GROUP BY p_name), keyed AS (SELECT DISTINCT id, unnest([substr(name, 1, 1), string_split(name, ' ')[-1]]) AS key FROM names)"


def _names(spark, d):
    own = v.part_names(spark, d)
    return own.select("id", tx.normalize_string(F.col("name")).alias("name"))


@query("WITH " + _KEYS + " SELECT id, key FROM keyed")
def blocking_keys(spark, d):
    return _names(spark, d).select("id", F.explode(resolution.blocking_keys(F.col("name"))).alias("key")).distinct()


@query("WITH " + _KEYS + " SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM keyed a JOIN keyed b ON a.key = b.key AND a.id < b.id")
def candidate_pairs_full(spark, d):
    return resolution.candidate_pairs(_names(spark, d))


@query()
def candidate_pairs_budgeted(spark, d):
    own = v.persons(spark, d).select(F.col("person_id").alias("id"), tx.normalize_string(F.col("name")).alias("name"))
    return resolution.candidate_pairs(own, 2000)


_JACCARD = ", pr AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, x.name AS na, y.name AS nb FROM keyed a JOIN keyed b ON a.key = b.key AND a.id < b.id JOIN names x ON x.id = a.id JOIN names y ON y.id = b.id)"


@query("WITH " + _KEYS + _JACCARD + ", s AS (SELECT id_a, id_b, list_distinct(string_split(na, ' ')) AS x, list_distinct(string_split(nb, ' ')) AS y FROM pr) SELECT id_a, id_b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM s")
def token_jaccard_pairs(spark, d):
    own = _names(spark, d)
    a, b = own.select(F.col("id").alias("id_a"), F.col("name").alias("na")), own.select(F.col("id").alias("id_b"), F.col("name").alias("nb"))
    return resolution.candidate_pairs(own).join(a, "id_a").join(b, "id_b").select("id_a", "id_b", F.round(tx.token_jaccard(F.col("na"), F.col("nb")), 6).alias("jaccard"))


@query("WITH " + _KEYS + _JACCARD + ", wd AS (SELECT id, ' ' || unnest(string_split(name, ' ')) || ' ' AS w FROM names), gr AS (SELECT id, substr(w, p, n) AS gram FROM wd, range(1, 40) r(p), (VALUES (2), (3)) t(n) WHERE p + n - 1 <= length(w)), tf AS (SELECT id, gram, count(*) AS tf FROM gr GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT id, tf.gram, tf * (ln((1 + (SELECT count(*) FROM names)) / (1 + df)) + 1) AS v FROM tf JOIN df ON tf.gram = df.gram), nm AS (SELECT id, sqrt(sum(v * v)) AS nm FROM raw GROUP BY 1), wt AS (SELECT raw.id, gram, v / nm AS w FROM raw JOIN nm ON raw.id = nm.id) SELECT id_a, id_b, round(sum(a.w * b.w), 6) AS cosine FROM pr JOIN wt a ON a.id = id_a JOIN wt b ON b.id = id_b AND a.gram = b.gram GROUP BY 1, 2")
def tfidf_cosine_pairs(spark, d):
    own = _names(spark, d)
    return resolution.cosines(resolution.candidate_pairs(own), resolution.tfidf(own)).select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


@query()
def er_baseline(spark, d):
    return resolution.resolve(v.part_names(spark, d), "baseline", 0.6)


@query()
def er_multi_feature(spark, d):
    return resolution.resolve(v.part_names(spark, d), "multi_feature", 0.55)


@query("WITH p AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS x, greatest(o_custkey, l_suppkey) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.05), t AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS x, greatest(o_custkey, l_suppkey) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_tax > 0.04), c AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM t)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM t)) AS fp, (SELECT count(*) FROM (FROM t EXCEPT FROM p)) AS fn) SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1_score FROM c")
def er_evaluation(spark, d):
    t = v.trades(spark, d)
    found = evaluate.pairs(t.where("l_discount > 0.05"), "o_custkey", "l_suppkey")
    return evaluate.evaluate(found, evaluate.pairs(t.where("l_tax > 0.04"), "o_custkey", "l_suppkey"))


_Z = "WITH m AS (SELECT median(value) AS m FROM events), s AS (SELECT median(abs(value - m)) AS mad, any_value(m) AS m FROM events, m), z AS (SELECT 'V' || event_id AS transaction_id, event_type, value AS amount, abs((value - m) / CASE WHEN mad > 0 THEN mad * 1.4826::DOUBLE ELSE 1e-9 END) AS z FROM events, s)\n"


@query(_Z + "SELECT transaction_id, amount, round(z, 4) AS anomaly_score FROM z WHERE z >= 3")
def anomalies_robust_z(spark, d):
    return anomaly.robust_z(v.amounts(spark, d)).select("transaction_id", "amount", "anomaly_score")


@query()
def anomalies_robust_z_reason(spark, d):
    return anomaly.robust_z(v.amounts(spark, d)).select("transaction_id", "reason")


@query()
def anomalies_isolation_forest(spark, d):
    return anomaly.isolation_forest(v.amounts(spark, d), 0.05)


_EVAL = _Z + ", p AS (SELECT transaction_id AS k FROM z WHERE z >= 3), t AS (SELECT 'V' || event_id AS k FROM events WHERE event_type = 'error'), c AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM t)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM t)) AS fp, (SELECT count(*) FROM (FROM t EXCEPT FROM p)) AS fn) "


@query(_EVAL + "SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) ELSE 0 END AS f1_score FROM c")
def anomaly_evaluation(spark, d):
    own = v.amounts(spark, d)
    return evaluate.evaluate(anomaly.robust_z(own).select("transaction_id"), own.where("destination = 'error'").select("transaction_id"))


@query(_EVAL + "SELECT round(fp / ((SELECT count(*) FROM events) - (SELECT count(*) FROM t)), 4) AS false_positive_rate FROM c")
def false_positive_rate(spark, d):
    own = v.amounts(spark, d)
    truth = own.where("destination = 'error'").select("transaction_id")
    return evaluate.false_positive_rate(evaluate.evaluate(anomaly.robust_z(own).select("transaction_id"), truth), own.count(), truth.count())


_NOTES = "WITH notes AS (SELECT 'O' || o_orderkey AS source_id, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS nation, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)\n"


def _note_mentions(spark, d):
    return extraction.extract_for_texts(v.order_notes(spark, d), "event_id", "description")


_NOTE_TEXT = _NOTES.replace("FROM orders", ", 'the buyer Rosa Lindqvist of ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' ordered on ' || strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') || ' from Harbor Mills.' AS note FROM orders")
_NOTE_MENTIONS = "(SELECT source_id, note, day AS entity_text, 'DATE' AS label FROM notes UNION ALL SELECT source_id, note, 'Rosa Lindqvist', 'PROPER_NOUN' FROM notes UNION ALL SELECT source_id, note, 'Harbor Mills', 'PROPER_NOUN' FROM notes)"


@query(_NOTE_TEXT + f"SELECT source_id, entity_text, label, CAST(strpos(note, entity_text) - 1 AS INTEGER) AS start_char, CAST(strpos(note, entity_text) - 1 + length(entity_text) AS INTEGER) AS end_char, 'baseline' AS method FROM {_NOTE_MENTIONS}")
def mention_offsets(spark, d):
    return extraction.extract(v.order_notes(spark, d), "description").select(F.col("event_id").alias("source_id"), "entity_text", "label", "start_char", "end_char", "method")


@query(_NOTES + "SELECT source_id, day AS entity_text FROM notes")
def date_mentions(spark, d):
    return _note_mentions(spark, d).where("label = 'DATE'").select("source_id", "entity_text")


@query(_NOTES + "SELECT 'DATE' AS label, count(*) AS mention_count FROM notes UNION ALL SELECT 'PROPER_NOUN', CAST(sum(2 + len(regexp_extract_all(n_title, '\\b[A-Z][a-zA-Z]*( +[A-Z][a-zA-Z]*)*\\b'))) AS BIGINT) FROM (SELECT array_to_string([upper(substr(x, 1, 1)) || substr(x, 2) for x in string_split(lower(nation), ' ')], ' ') AS n_title FROM notes)")
def mentions_by_label(spark, d):
    return relational.mentions_by_label(_note_mentions(spark, d))


#: Capitalised runs between characters that are no word characters. SQL's expressions can't look ahead, so each such character stands twice: one
#: ends a run, the other may begin the next. The conversations hold no dates.
_RUNS = r"""SELECT source_id, regexp_replace(run, ' +', ' ', 'g') AS entity_text, 'PROPER_NOUN' AS label, 'baseline' AS method FROM (
  SELECT conv_id AS source_id, unnest(regexp_extract_all(regexp_replace(' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ', '([^\pL\pN_])', '\1\1', 'g'), '[^\pL\pN_]([A-Z][a-zA-Z]*(?: +[A-Z][a-zA-Z]*)*)[^\pL\pN_]', 1)) AS run FROM conversations)
WHERE length(run) > 1 AND lower(run) NOT IN (""" + ", ".join(f"'{w}'" for w in extraction.LEADING) + ")"


@query(_RUNS)
def proper_noun_mentions(spark, d):
    return extraction.extract_for_texts(v.table(spark, d, "conversations"), "conv_id", "text")


@query(_NOTE_TEXT + f"SELECT source_id, entity_text, label, 'baseline' AS method, substr(note, 1, 40) || '...' AS description FROM {_NOTE_MENTIONS}")
def mentions_with_description(spark, d):
    notes = v.order_notes(spark, d)
    return relational.with_description(_note_mentions(spark, d), notes, 40)


@query(r"SELECT doc_id, CAST(len([x for x in string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) if trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '']) AS BIGINT) AS sentences FROM documents")
def sentence_counts(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.size(extraction.split_sentences(F.col("text"))).cast("long").alias("sentences"))


QUESTIONS = ["What is in here?", "Which firm has the most connections?", "Is there a path between Dora and Emil?", "List unusual payments", "Show potential matches among customers", "How clean are the tables?", "Who is most central?", "Who links Customer and Supplier?"]


@query("SELECT question, CASE WHEN regexp_matches(question, '(?i)\\bconnect(ed|ion)?\\b.*\\band\\b|\\bhow (is|are)\\b.*\\bconnected\\b|\\bpath between\\b') THEN 'shortest_path' WHEN regexp_matches(question, '(?i)\\bmost connect(ed|ions?)\\b|\\bcentral\\b') THEN 'most_connected' WHEN regexp_matches(question, '(?i)\\bunusual\\b') THEN 'anomalies' WHEN regexp_matches(question, '(?i)\\bpotential match\\w*\\b') THEN 'duplicates' WHEN regexp_matches(question, '(?i)\\bhow clean\\b') THEN 'quality' ELSE 'overview' END AS intent FROM (VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ") AS t(question)")
def intent_detection(spark, d):
    return spark.createDataFrame([(q,) for q in QUESTIONS], "question string").select("question", assistant.intent(F.col("question")).alias("intent"))


@query(", hits AS (SELECT * FROM (SELECT person_id AS id, name, 'Person' AS type, 0 AS r FROM persons WHERE lower(name) LIKE '%customer%' ORDER BY 1 LIMIT 3) UNION ALL SELECT * FROM (SELECT organization_id, name, 'Organization', 1 FROM organizations WHERE lower(name) LIKE '%supplier%' ORDER BY 1 LIMIT 3)) SELECT 'who links Customer and Supplier?' AS question, CAST(row_number() OVER (ORDER BY r, id) AS INTEGER) AS position, id, name, type FROM hits", True)
def mentioned_entities(spark, d):
    asked = spark.createDataFrame([("who links Customer and Supplier?",), ("nobody is named here",)], "question string")
    return assistant.mentioned_entities(asked, v.persons(spark, d), v.organizations(spark, d))


def _data(spark, d):
    t = v.entity_tables(spark, d)
    t["transactions"] = v.amounts(spark, d)
    one = profile.summarize(v.table(spark, d, "customer")).first()
    return assistant.Dataset("star schema", one.row_count, t, 88.0, one.missing_value_pct, one.duplicate_row_pct)


def _told(answer):
    return answer.select("intent", F.array_join("evidence", "\n").alias("facts"), F.element_at("sources", 1).alias("source"), "mode")


@query(", n AS (SELECT 1 AS k, 'persons' AS t, count(*) AS n FROM persons UNION ALL SELECT 2, 'organizations', count(*) FROM organizations UNION ALL SELECT 3, 'locations', count(*) FROM locations UNION ALL SELECT 4, 'events', count(*) FROM evs UNION ALL SELECT 5, 'relationships', count(*) FROM relationships UNION ALL SELECT 6, 'transactions', count(*) FROM events) SELECT 'overview' AS intent, 'star schema holds ' || format('{:,}', (SELECT count(*) FROM customer)) || ' rows in all' || chr(10) || string_agg(t || ': ' || format('{:,}', n) || ' rows', chr(10) ORDER BY k) || chr(10) || 'Its quality score is 88 of 100' AS facts, 'count_entities' AS source, 'fallback' AS mode FROM n", True)
def assistant_overview(spark, d):
    return _told(assistant.answer(QUESTIONS[0], _data(spark, d)))


@query("SELECT 'quality' AS intent, 'The quality score is 88 of 100' || chr(10) || '0.00 % of the cells are empty' || chr(10) || format('{:.2f} % of the rows repeat another', 100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer))) / count(*)) AS facts, 'datasets' AS source, 'fallback' AS mode FROM customer")
def assistant_quality(spark, d):
    return _told(assistant.answer(QUESTIONS[5], _data(spark, d)))


@query(", moves AS (SELECT 'C' || user_id AS src, event_type AS dst FROM events), own AS (SELECT src, dst FROM edges WHERE edge_type <> 'TRANSFERRED_TO' UNION ALL SELECT src, dst FROM moves WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)), k AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM own UNION ALL SELECT dst FROM own) GROUP BY 1), best AS (SELECT n.id, label, k / ((SELECT count(*) FROM nodes) - 1) AS score FROM nodes n JOIN k ON k.id = n.id ORDER BY k DESC, n.id LIMIT 5) SELECT 'most_connected' AS intent, string_agg(label || ' has degree centrality ' || format('{:.4f}', score), chr(10) ORDER BY score DESC, id) || CASE WHEN (SELECT count(*) FROM nodes) > 3000 THEN chr(10) || 'Degrees are exact; betweenness would be sampled for a graph of this size' ELSE '' END AS facts, 'build_edges' AS source, 'fallback' AS mode FROM best", True)
def assistant_most_connected(spark, d):
    return _told(assistant.answer(QUESTIONS[6], _data(spark, d)))


@query()
def assistant_shortest_path(spark, d):
    return _told(assistant.answer("How is Customer#000000001 connected to Customer#000000002?", _data(spark, d)))


@query(_Z + ", found AS (SELECT * FROM z WHERE z >= 3), best AS (SELECT row_number() OVER (ORDER BY round(z, 4) DESC, transaction_id) AS k, 'Potential anomaly ' || transaction_id || ': an amount of ' || format('{:,.2f}', round(amount, 2)) || ' scores ' || format('{:.2f}', round(round(z, 4), 2)) AS fact FROM found ORDER BY k LIMIT 5), told AS (SELECT 0 AS k, format('{:,} of {:,} transactions are potential anomalies', (SELECT count(*) FROM found), (SELECT count(*) FROM events)) AS fact UNION ALL SELECT k, fact FROM best) SELECT 'anomalies' AS intent, string_agg(fact, chr(10) ORDER BY k) AS facts, 'robust_z' AS source, 'fallback' AS mode FROM told")
def assistant_anomalies(spark, d):
    return _told(assistant.answer(QUESTIONS[3], _data(spark, d)))


@query()
def assistant_duplicates(spark, d):
    data = _data(spark, d)
    data.tables["persons"] = v.part_names(spark, d).select(F.col("id").alias("person_id"), "name", F.lit(None).cast("string").alias("organization_id"), F.lit("").alias("country"), F.lit("").alias("city"))
    return _told(assistant.answer(QUESTIONS[4], data))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/customer.csv"
    store.write_csv(v.table(spark, d, "customer"), path)
    return readers.load(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def json_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/nation.json"
    rows = v.table(spark, d, "nation").select(F.array(F.struct("*")).alias("r")).groupBy().agg(F.to_json(F.flatten(F.collect_list("r"))).alias("value"))  # 25 nations at any scale
    rows.write.text(path)
    return readers.load(spark, path)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def xlsx_roundtrip(spark, d):
    from spindrift.sources.xlsx import write_workbooks

    return readers.load_workbooks(spark, write_workbooks(v.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), shared_folder(spark)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE o_totalprice END AS confidence FROM orders")
def typed_load_orders(spark, d):
    raw = v.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return raw.select("o_orderkey", readers.to_date(F.col("day")).alias("day"), readers.to_number(F.col("price"), 1.0).alias("confidence"))


def _csv_folder(spark, d) -> str:
    """The entity tables as the CSV files that a data set is loaded from, and two tables of truth."""
    folder = shared_folder(spark)
    pairs = v.table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("person_id"), F.concat(F.lit("C"), (F.col("c_custkey") + 1).cast("string")).alias("true_identity_id"))
    odd = v.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("V"), F.col("event_id").cast("string")).alias("transaction_id"))
    synthetic.write_dataset(v.entity_tables(spark, d) | {"ground_truth_entity_resolution": pairs, "ground_truth_anomalies": odd}, folder, "star")
    return folder


def _stored(spark, d) -> store.Store:
    """A store with two data sets: `star`, loaded from CSV files, and `suppliers`, put in table by table."""
    own = store.Store(spark, f"{shared_folder(spark)}/store")
    own.load_dataset(_csv_folder(spark, d), "star", "star")
    firms = v.organizations(spark, d)
    key = own.create_dataset("suppliers", firms.count(), 2, 0.0, 0.0, None, "one table")
    own.append("organizations", firms.withColumn("dataset_id", F.lit(key)))
    own.add_source(key, "supplier.parquet", file_type="parquet")
    return own


def _key(own: store.Store, name: str) -> str:
    return own.datasets().where(F.col("name") == name).first().dataset_id


_ENTITY_COUNTS = "SELECT 'star' AS name, 'persons' AS table_name, count(*) AS record_count FROM persons UNION ALL SELECT 'star', 'organizations', count(*) FROM organizations UNION ALL SELECT 'star', 'locations', count(*) FROM locations UNION ALL SELECT 'star', 'events', count(*) FROM evs UNION ALL SELECT 'star', 'relationships', count(*) FROM relationships UNION ALL SELECT 'star', 'transactions', count(*) FROM transactions"


@query(f", k AS ({_ENTITY_COUNTS}), p AS (SELECT count(*) AS n, count(*) - count(organization_id) AS gaps FROM persons) SELECT 'star' AS name, 'scale=star' AS description, CAST((SELECT sum(record_count) FROM k) AS INTEGER) AS row_count, CAST(5 AS INTEGER) AS column_count, round(100.0 * gaps / (n * 5), 2) AS missing_value_pct, CAST(0 AS DOUBLE) AS duplicate_row_pct, round(((1 - gaps / (n * 5)) * 0.40::DOUBLE + 0.25::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE) * 100, 2) AS quality_score FROM p", True)
def store_load_dataset(spark, d):
    own = _stored(spark, d)
    return own.dataset(_key(own, "star")).select("name", "description", "row_count", "column_count", "missing_value_pct", "duplicate_row_pct", "quality_score")


@query(f", k AS ({_ENTITY_COUNTS}) SELECT * FROM k UNION ALL SELECT 'suppliers', 'organizations', count(*) FROM organizations", True)
def store_counts_by_dataset(spark, d):
    own = _stored(spark, d)
    counts = relational.counts_by_dataset({t: own.table(t) for t in store.ENTITIES})
    return counts.join(F.broadcast(own.datasets().select("dataset_id", "name")), "dataset_id").select("name", "table_name", "record_count")


@query("SELECT 'star' AS name, t || '_star.csv' AS original_filename, 'csv' AS file_type FROM (VALUES ('persons'), ('organizations'), ('locations'), ('events'), ('relationships'), ('transactions')) AS v(t) UNION ALL SELECT 'suppliers', 'supplier.parquet', 'parquet'")
def store_sources(spark, d):
    own = _stored(spark, d)
    return own.table("data_sources").join(F.broadcast(own.datasets().select("dataset_id", "name")), "dataset_id").select("name", "original_filename", "file_type")


@query("SELECT transaction_id, source, destination, amount, CAST(timestamp AS TIMESTAMP) AS timestamp FROM transactions", True)
def store_list_transactions(spark, d):
    own = _stored(spark, d)
    return own.entities(_key(own, "star"))["transactions"].select("transaction_id", "source", "destination", "amount", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("SELECT event_id, event_type, date, location_id FROM evs", True)
def store_list_events(spark, d):
    own = _stored(spark, d)
    return own.entities(_key(own, "star"))["events"].select("event_id", "event_type", "date", "location_id")


@query(_Z + "SELECT 'anomaly_detection' AS run_type, '{\"z\": 3.0}' AS parameters, TRUE AS finished, 'transaction' AS entity_type, transaction_id AS entity_id, round(z, 4) AS anomaly_score FROM z WHERE z >= 3")
def store_anomaly_runs(spark, d):
    own = store.Store(spark, f"{shared_folder(spark)}/store")
    key = own.create_dataset("amounts", 0, 5)
    run = own.record_anomalies(key, anomaly.robust_z(v.amounts(spark, d)), {"z": 3.0})
    own.start_run(own.create_dataset("other", 0, 5), "entity_resolution")
    runs = own.runs(key).select("run_id", "run_type", "parameters", F.col("finished_at").isNotNull().alias("finished"))
    return own.anomalies(run).join(F.broadcast(runs), "run_id").select("run_type", "parameters", "finished", "entity_type", "entity_id", "anomaly_score")


@query("SELECT least('C' || c_custkey, 'C' || (c_custkey + 1)) AS id_a, greatest('C' || c_custkey, 'C' || (c_custkey + 1)) AS id_b FROM customer WHERE c_custkey % 50 = 0")
def truth_pairs(spark, d):
    return store.true_pairs(spark, _csv_folder(spark, d), "star")


@query("SELECT 'V' || event_id AS transaction_id FROM events WHERE event_type = 'error'")
def truth_anomalies(spark, d):
    return store.true_anomalies(spark, _csv_folder(spark, d), "star")


@query(_ENTITY_COUNTS.replace("'star' AS name, ", "").replace("'star', ", ""), True)
def dataset_csv_files(spark, d):
    folder = _csv_folder(spark, d)
    return relational.count_entities({t: readers.load(spark, f"{folder}/{t}_star.csv") for t in store.ENTITIES})


@query()
def er_method_comparison(spark, d):
    t = synthetic.generate(spark, 1000)
    truth = t["ground_truth_entity_resolution"].select(F.col("person_id").alias("id_a"), F.col("true_identity_id").alias("id_b"))
    return resolution.compare_methods(t["persons"].select(F.col("person_id").alias("id"), "name"), truth, 0.70)


@query("SELECT 'spindrift' AS app, 'development' AS environment, 'ok' AS status")
def health(spark, d):
    return settings.health(spark)


@query()
def synthetic_dataset(spark, d):
    t = synthetic.generate(spark, 1000)
    return relational.count_entities(t)


@query()
def synthetic_persons(spark, d):
    return synthetic.generate(spark, 1000)["persons"]


@query()
def graph_metrics(spark, d):
    return graph.graph_metrics(*v.full_graph(spark, d), top=5)


#: The pages of a front end, and the queries that each one shows.
PAGES = {
    "Overview": ["overview_kpis", "entity_counts", "datasets_latest_first"],
    "Upload": ["csv_roundtrip", "json_roundtrip", "xlsx_roundtrip", "profile_summary", "preview_head", "validation_report", "quality_breakdown", "clean_report"],
    "Synthetic data": ["synthetic_dataset", "dataset_csv_files", "store_load_dataset"],
    "Data sets": ["selector_labels", "dataset_by_id", "store_counts_by_dataset", "store_sources"],
    "Graph": ["search_entities", "neighborhood_k2", "neighborhood_edges_filtered", "edge_types", "shortest_path_hops", "node_styles", "edge_styles", "graph_metrics"],
    "Timeline": ["event_types", "event_date_range", "timeline_filter"],
    "Map": ["map_event_counts"],
    "Entity resolution": ["er_baseline", "er_multi_feature", "er_evaluation", "er_method_comparison", "truth_pairs"],
    "Anomalies": ["anomalies_robust_z", "anomalies_isolation_forest", "anomaly_evaluation", "false_positive_rate", "store_anomaly_runs", "truth_anomalies"],
    "Text": ["mentions_by_label", "mentions_with_description", "mention_offsets", "proper_noun_mentions"],
    "Assistant": ["intent_detection", "mentioned_entities", "assistant_overview", "assistant_most_connected", "assistant_shortest_path", "assistant_anomalies", "assistant_duplicates", "assistant_quality"],
}
