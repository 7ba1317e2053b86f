"""Queries over records, documents and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest import views
from inquest.catalog.registry import query
from inquest.operators import records, resolution, review
from inquest.operators.components import components
from inquest.storage import stored, table


@query("SELECT doc_id, source, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content."""
    return records.first_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "doc_id").select("doc_id", "source", "content_hash")


@query("SELECT source AS case_id, count(*) AS n_documents FROM documents WHERE source IS NOT NULL GROUP BY source")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per case."""
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("case_id")).agg(F.count(F.lit(1)).alias("n_documents"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest orders: a report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("SELECT lang AS doc_type, count(*) AS n, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY lang")
def doc_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their mean length by type."""
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer."""
    return records.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", F.desc("o_orderdate"), "o_orderkey")


@query("""SELECT doc_id, 0 AS pos, 'id:lang' AS field_name, lang AS field_value FROM documents UNION ALL SELECT doc_id, 1, 'id:source', source FROM documents
UNION ALL SELECT doc_id, 2, 'amount:n_chars', CAST(n_chars AS VARCHAR) FROM documents""")
def field_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document columns as field rows."""
    return records.flattened(table(spark, sf_dir, "documents"), "doc_id", {"lang": "id:lang", "source": "id:source", "n_chars": "amount:n_chars"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, 1 - l_discount AS confidence, 'low_confidence_field' AS flag FROM lineitem WHERE 1 - l_discount < 0.95")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines below a confidence of 0.95."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_discount")).alias("confidence"))
    return records.low_confidence(lines, "confidence", 0.95)


@query("""WITH o AS (SELECT 'identifier:' || sha256(text) AS key, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS norm FROM documents WHERE trim(source) <> ''
UNION ALL SELECT 'case_reference', regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') FROM documents WHERE trim(source) <> '' UNION ALL SELECT 'district', trim(lower(lang)) FROM documents WHERE trim(lang) <> '')
SELECT key, count(DISTINCT norm) AS n_values, count(*) AS n_observations, CASE WHEN key = 'case_reference' THEN 'high' ELSE 'medium' END AS severity FROM o GROUP BY key HAVING count(DISTINCT norm) > 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are filed under several sources, and the sources and languages as one case's reference and district."""
    docs = table(spark, sf_dir, "documents")
    filed = F.struct(F.concat(F.lit("identifier:"), F.sha2("text", 256)).alias("key"), F.col("source").alias("value"))
    case = F.struct(F.lit("case_reference").alias("key"), F.col("source").alias("value"))
    place = F.struct(F.lit("district").alias("key"), F.col("lang").alias("value"))
    return review.contradictions(docs.select(F.inline(F.array(filed, case, place))))


@query("SELECT p_name AS identifier, count(DISTINCT l_orderkey) AS n_documents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name HAVING count(DISTINCT l_orderkey) > 1")
def identifier_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the orders that they occur in."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("identifier"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return review.cross_references(lines, "identifier", "l_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n_items, arg_max(o_orderpriority, o_orderkey) AS currency FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey")
def money_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending per customer."""
    items = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("currency"), F.col("o_orderkey").alias("ord"))
    return review.ledger(items, "o_custkey").withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey AS case_id, o_orderdate AS first_at, z AS then_at, 'TEMPORAL_CONTRADICTION' AS flag FROM orders
JOIN (SELECT l_orderkey, min(l_shipdate) AS z FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE z < o_orderdate""")
def date_order_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line shipped before the order date."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("ship").alias("kind"), F.col("l_shipdate").alias("at"))
    return review.out_of_order(ordered.unionByName(shipped), "case_id", "order", "ship").where("first_at IS NOT NULL")


@query("""WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT k, c, CASE WHEN k % 2 = 0 THEN round(c, 2) ELSE o_totalprice END AS stated FROM l JOIN orders ON k = o_orderkey WHERE n >= 2)
SELECT k AS o_orderkey, round(c, 2) AS computed, round(stated, 2) AS stated, abs(c - stated) <= 0.02 AS matched FROM s""")
def invoice_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against their lines; for even keys the stated total is the rounded sum."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("value"))
    even = lines.where("o_orderkey % 2 = 0").groupBy("o_orderkey").agg(F.round(F.sum("value"), 2).alias("value"))
    stated = table(spark, sf_dir, "orders").where("o_orderkey % 2 <> 0").select("o_orderkey", F.col("o_totalprice").alias("value")).unionByName(even)
    amounts = lines.withColumn("class", F.lit("line")).unionByName(stated.withColumn("class", F.lit("total")))
    return review.arithmetic(amounts, "o_orderkey").select("o_orderkey", F.round("computed", 2).alias("computed"), F.round("stated", 2).alias("stated"), "matched")


COMPACT = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(f"""SELECT a.conv_id, a.turn, {COMPACT.format('a.role')} AS first, {COMPACT.format('b.role')} AS second FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
WHERE {COMPACT.format('a.role')} IS DISTINCT FROM {COMPACT.format('b.role')}""")
def dual_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of consecutive turns as two runs that are compared by position."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("value"))
    return review.dual_run(turns, turns.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


@query("""SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_id, n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the least id of their nation and segment."""
    people = table(spark, sf_dir, "customer")
    mapping = records.canonical_ids(people, ["c_nationkey", "c_mktsegment"], "c_custkey")
    named = people.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_custkey").alias("canonical_id"), "n_name")
    return records.remapped(named, "canonical_id", mapping).withColumnRenamed("c_custkey", "id")


@query("SELECT DISTINCT l_orderkey || '-S' || l_suppkey AS object_id, 'DANGLING_TARGET_ENDPOINT' AS code FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with suppliers outside some nations."""
    nodes = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(views.organization("s_suppkey").alias("node_id"))
    return records.dangling(views.interaction_edges(spark, sf_dir), nodes, "target_id", "DANGLING_TARGET_ENDPOINT")


@query("""SELECT c_nationkey AS cluster, min(c_acctbal) AS confidence, array_to_string(list_sort(list(DISTINCT c_name)), ',') AS aliases,
array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS types, count(DISTINCT c_custkey) AS n_members FROM customer GROUP BY c_nationkey""")
def merge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation merged into one entity."""
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("confidence"))
    found = records.merged_members(members, "cluster")
    return found.select("cluster", "confidence", F.array_join("aliases", ",").alias("aliases"), F.array_join("types", ",").alias("types"), F.size("member_ids").cast("long").alias("n_members"))


JACCARD = """n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS w FROM n),
c AS (SELECT a.name AS l, b.name AS r, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM t a JOIN t b ON a.name < b.name)"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lit("PART").alias("type")).distinct(), "part-names")


@query(f"WITH {JACCARD} SELECT l AS left_id, r AS right_id, round(jaccard, 6) AS jaccard FROM c WHERE jaccard >= 0.3")
def er_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that share a third of their words."""
    found = resolution.token_pairs(part_names(spark, sf_dir), 0.3)
    return found.select("left_id", "right_id", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH RECURSIVE {JACCARD}, e AS (SELECT l AS a, r AS b FROM c WHERE jaccard >= 0.3 UNION SELECT r, l FROM c WHERE jaccard >= 0.3),
r(a, b) AS (SELECT name, name FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS cluster FROM r GROUP BY a""")
def er_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names joined into clusters."""
    names = part_names(spark, sf_dir)
    parts = components(resolution.token_pairs(names, 0.3).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    return names.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


@query("""SELECT 'FIELD' AS object_type, count(*) AS n_items FROM documents UNION ALL SELECT 'EVENT', count(*) FROM orders UNION ALL SELECT 'ENTITY', count(*) FROM customer""")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of provenance by type."""
    return review.provenance_counts({"FIELD": table(spark, sf_dir, "documents"), "EVENT": table(spark, sf_dir, "orders"), "ENTITY": table(spark, sf_dir, "customer")})


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey")
def ref_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each part and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    return records.first_references(lines, ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(concat_ws(' ', doc_id, source, lang)), 'src1') ORDER BY source, doc_id LIMIT 15 OFFSET 15")
def ledger_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search: a report."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return review.page(rows, "SRC1", ["doc_id", "source", "lang"], ["source", "doc_id"], 2)


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) AS value FROM documents""")
def text_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in dotted form found in texts."""
    pattern = F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("value"))
