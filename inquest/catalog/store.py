"""Queries over the record store and lookups in the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest import views
from inquest.catalog.graph import NETWORK, SEED, _walk_sql, network, seed
from inquest.catalog.records import contradictions
from inquest.catalog.registry import SQL, query
from inquest.catalog.temporal import MET, NOVEL, QUARTER, YEAR, YEAR_BEFORE, between, lit
from inquest.operators import anomaly, paths, projection, provenance, review, store, temporal
from inquest.storage import table


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def case_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of one customer in order of their date."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    one = orders.agg(F.min("o_custkey")).first()[0]
    return store.case_scan(orders, "o_custkey", one, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, count(l_linenumber) AS n_children, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def document_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines nested in order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    held = store.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return held.select("o_orderkey", F.size("lines").cast("long").alias("n_children"), text.alias("children"))


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and lines, those without any too."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return store.batch_rows(table(spark, sf_dir, "customer").select("c_custkey"), orders, lines, "c_custkey", "o_orderkey").select("c_custkey", "o_orderkey", "l_linenumber")


@query("""SELECT c_custkey, o_orderkey AS latest_order, o_orderstatus AS latest_status FROM customer LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their latest order as one struct."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    flat = store.with_latest_child(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderdate", "o_orderkey")
    return flat.select("c_custkey", F.col("latest_extraction.o_orderkey").alias("latest_order"), F.col("latest_extraction.o_orderstatus").alias("latest_status"))


@query("""SELECT o_orderkey, o_orderpriority AS original_value, coalesce(f, o_orderpriority) AS field_value, coalesce(s, 'PENDING') AS review_status FROM orders LEFT JOIN
(SELECT l_orderkey AS k, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS f, arg_max(l_linestatus, (l_shipdate, l_returnflag)) AS s
 FROM (SELECT l_orderkey, l_shipdate, l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) GROUP BY 1) ON o_orderkey = k""")
def field_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority the flag of a returned line reviews, the last by shipping date."""
    fields = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("field_value"))
    back = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("reviewed_at"), F.col("l_returnflag").alias("new_value")).agg(F.max("l_linestatus").alias("status"))
    return store.reviewed(fields, back, ["o_orderkey"])


@query("SELECT doc_id, m AS original_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents WHERE text IS NOT NULL) WHERE doc_id <> m")
def linked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text an earlier one has, with that one."""
    arrivals = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return store.linked_duplicates(arrivals, "content_hash", "doc_id")


@query("""SELECT o_orderdate AS at, 'CREATED' AS action, CAST(o_orderkey AS VARCHAR) AS object_id, o_orderstatus AS detail FROM orders
UNION ALL SELECT l_shipdate, 'SHIPPED', CAST(l_orderkey AS VARCHAR), l_returnflag FROM lineitem""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to orders, by time."""
    made = store.audit(table(spark, sf_dir, "orders"), "CREATED", "o_orderdate", "o_orderkey", F.col("o_orderstatus"))
    sent = store.audit(table(spark, sf_dir, "lineitem"), "SHIPPED", "l_shipdate", "l_orderkey", F.col("l_returnflag"))
    return made.unionByName(sent).orderBy("at")


@query("SELECT doc_id, 'id:lang' AS field_name, lang AS field_value, 'identifiers' AS category FROM documents WHERE contains(lower('id:lang ' || lang), 'en')")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language fields that hold a text."""
    fields = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", F.lit("id:lang").alias("field_name"), F.col("lang").alias("field_value"))
    return store.field_search(fields, "EN", "identifiers")


@query("SELECT count(*) AS n_fields, round(avg(1 - l_discount), 6) AS mean_confidence, count(*) FILTER (WHERE 1 - l_discount < 0.955) AS n_low FROM lineitem")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence over all lines."""
    found = store.dashboard(table(spark, sf_dir, "lineitem").select((1 - F.col("l_discount")).alias("confidence")), 0.955)
    return found.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"SELECT severity, count(*) AS n FROM ({SQL['contradictions']}) GROUP BY severity")
def contradiction_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions by severity."""
    return review.severity_counts(contradictions(spark, sf_dir))


@query("""SELECT sha256(text) AS key, trim(regexp_replace(lower(source), '\\s+', ' ', 'g')) AS norm, min(doc_id) AS doc_id FROM documents
WHERE text IS NOT NULL AND trim(source) <> '' GROUP BY ALL""")
def first_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text and source."""
    seen = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), F.col("source").alias("value"), "doc_id")
    return review.first_observations(seen, "doc_id").select("key", "norm", "doc_id")


@query("SELECT DISTINCT 'S' || l_suppkey AS object_id, CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS page, l_returnflag AS text_span FROM lineitem")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct references of suppliers to lines."""
    lines = table(spark, sf_dir, "lineitem").select(views.organization("l_suppkey").alias("object_id"), F.col("l_orderkey").cast("string").alias("document_id"), F.lit("").alias("filename"), F.lit("").alias("file_hash"), F.col("l_linenumber").alias("page"), F.lit("").alias("bounding_box"), F.col("l_returnflag").alias("text_span"))
    return provenance.unique_references(lines).select("object_id", "document_id", "page", "text_span")


@query(f"""WITH {MET} SELECT (SELECT count(*) FROM (SELECT src FROM m UNION SELECT dst FROM m)) + (SELECT count(DISTINCT event_id) FROM m) AS n_nodes,
(SELECT count(*) FROM (SELECT src FROM m UNION SELECT dst FROM m)) AS n_entities, (SELECT count(DISTINCT event_id) FROM m) AS n_events, (SELECT count(*) FROM m) AS n_edges""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the graph of interactions."""
    met = views.interactions(spark, sf_dir)
    ends = met.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("node_id")).distinct().withColumn("kind", F.lit("ENTITY"))
    happened = met.select(F.col("event_id").cast("string").alias("node_id")).distinct().withColumn("kind", F.lit("EVENT"))
    return projection.counts(ends.unionByName(happened), met)


@query(f"WITH {NETWORK} SELECT DISTINCT src AS node_id, 'in' AS direction FROM g WHERE dst = {SEED} UNION ALL SELECT DISTINCT dst, 'out' FROM g WHERE src = (SELECT min(src) FROM g)")
def directed_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that point to one supplier, and those that one customer points to."""
    g = network(spark, sf_dir)
    edges = g.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    to = projection.neighbors(edges, seed(g), "in").withColumn("direction", F.lit("in"))
    return to.unionByName(projection.neighbors(edges, g.agg(F.min("src")).first()[0], "out").withColumn("direction", F.lit("out")))


@query(f"WITH {NETWORK} SELECT src, dst FROM g JOIN customer ON src = 'C' || c_custkey JOIN supplier ON dst = 'S' || s_suppkey WHERE c_nationkey < 6 OR s_nationkey < 6")
def touching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with an end in some nations."""
    people = table(spark, sf_dir, "customer").where("c_nationkey < 6").select(views.person("c_custkey").alias("node_id"))
    firms = table(spark, sf_dir, "supplier").where("s_nationkey < 6").select(views.organization("s_suppkey").alias("node_id"))
    return projection.touching(network(spark, sf_dir).select("src", "dst"), people.unionByName(firms), ("src", "dst"))


@query(f"""WITH {NETWORK}, x AS (SELECT src, dst FROM g JOIN customer ON src = 'C' || c_custkey JOIN supplier ON dst = 'S' || s_suppkey WHERE c_nationkey < 6 AND s_nationkey < 6)
SELECT src AS node_id FROM x UNION SELECT dst FROM x""")
def shown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of some nations that have an edge among themselves."""
    people = table(spark, sf_dir, "customer").where("c_nationkey < 6").select(views.person("c_custkey").alias("node_id"))
    firms = table(spark, sf_dir, "supplier").where("s_nationkey < 6").select(views.organization("s_suppkey").alias("node_id"))
    edges = network(spark, sf_dir).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return projection.without_isolates(people.unionByName(firms), edges)[0]


@query(f"{_walk_sql(NETWORK, f'a = {SEED}', 2)} SELECT src, dst FROM g WHERE src IN (SELECT t FROM k) AND dst IN (SELECT t FROM k)")
def k_hop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among the nodes within two steps of one supplier."""
    g = network(spark, sf_dir)
    near = paths.hops(g, spark.createDataFrame([(seed(g),)], "node_id string"), 2)
    return paths.induced(g, near).select("src", "dst")


@query(f"WITH {NOVEL} SELECT src, dst, 'EVENT' AS support, CAST(event_id AS VARCHAR) AS object_id FROM x JOIN m USING (src, dst) WHERE {between('start_at', YEAR)}")
def finding_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target events behind every new pair."""
    met = views.interactions(spark, sf_dir)
    found = anomaly.novel_relationships(met, YEAR, YEAR_BEFORE).select("src", "dst")
    edges = views.interaction_edges(spark, sf_dir).where("false")
    return projection.supported(found, edges, temporal.in_window(met, lit(YEAR[0]), lit(YEAR[1])))


@query(f"""WITH {MET}, w AS (SELECT * FROM m WHERE {between('start_at', QUARTER)})
SELECT count(*) AS n_events, (SELECT count(*) FROM (SELECT src FROM w UNION SELECT dst FROM w)) AS n_entities, count(*) AS n_dated_edges, 0 AS n_undated_edges, count(DISTINCT (src, dst)) AS n_pairs FROM w""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the network of a quarter."""
    return temporal.snapshot_counts(views.interactions(spark, sf_dir), views.interaction_edges(spark, sf_dir), lit(QUARTER[0]), lit(QUARTER[1]))
