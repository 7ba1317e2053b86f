"""Queries over cases: persons, conflicts, resolved entities and nested values, derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.catalog.registry import query
from inquest.operators import crossdoc, display, leaves, resolution, review
from inquest.storage import stored, table


def part_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of their brand's case: each names itself, and the last word of its name in another role."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id"), F.col("p_partkey").cast("string").alias("document_id"), F.col("p_partkey").alias("ord"), "p_name", "p_type")
    named = F.array(F.struct(F.lit(0).alias("pos"), F.col("p_name").alias("name"), F.lower("p_type").alias("role")), F.struct(F.lit(1).alias("pos"), F.substring_index("p_name", " ", -1).alias("name"), F.lit("kind").alias("role")))
    return parts.select("case_id", "document_id", "ord", F.inline(named))


@query("""WITH RECURSIVE p AS (SELECT p_brand AS case_id, p_partkey AS doc, p_partkey * 2 AS place, p_name AS low, lower(p_type) AS role FROM part
  UNION ALL SELECT p_brand, p_partkey, p_partkey * 2 + 1, string_split(p_name, ' ')[-1], 'kind' FROM part),
n AS (SELECT case_id, low, row_number() OVER (PARTITION BY case_id ORDER BY min(place)) AS i FROM p GROUP BY case_id, low),
r AS (SELECT DISTINCT case_id, 0::BIGINT AS i, []::VARCHAR[] AS keys FROM n
  UNION ALL SELECT r.case_id, n.i, CASE WHEN len(list_filter(r.keys, lambda k: contains(k, n.low) OR contains(n.low, k))) > 0 THEN r.keys ELSE list_append(r.keys, n.low) END FROM r JOIN n ON n.case_id = r.case_id AND n.i = r.i + 1),
k AS (SELECT case_id, arg_max(keys, i) AS keys FROM r GROUP BY case_id),
m AS (SELECT n.case_id, low, keys, list_filter(keys, lambda k: contains(k, low) OR contains(low, k))[1] AS person FROM n JOIN k USING (case_id)),
c AS (SELECT case_id, person, list_position(any_value(keys), person) AS known, count(DISTINCT doc) AS n_documents, count(*) AS n_mentions, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM p JOIN m USING (case_id, low) GROUP BY case_id, person)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY n_documents DESC, length(person) DESC, known) AS place,
  array_to_string(list_transform(string_split(person, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS person, n_documents, n_mentions, roles FROM c""")
def case_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts reconciled in each brand."""
    found = crossdoc.persons(part_parties(spark, sf_dir))
    return found.select("case_id", "place", "person", "n_documents", "n_mentions", F.array_join("roles", ",").alias("roles"))


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of their customer's case: the month as FIR number, status as district, priority as identifier, and fields that cannot conflict."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.format_string("order-%d", F.col("o_orderkey")).alias("filename"), F.col("o_orderkey").alias("ord"), "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    field = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("field_name"), value.alias("field_value"))
    items = F.array(
        field(0, "id:FIR Number", F.date_format("o_orderdate", "MM / yyyy")), field(1, "District", F.concat(F.lit(" "), F.col("o_orderstatus"))), field(2, "id:Priority  Code", F.col("o_orderpriority")),
        field(3, "summary:text", F.col("filename")), field(4, "Order date", F.lit("same")), field(5, "id:clerk", F.lit(" ")),
    )
    return orders.select("case_id", "document_id", "filename", "ord", F.inline(items))


_CONFLICTS = """o AS (SELECT o_custkey AS case_id, o_orderkey AS ord, 0 AS pos, 'id:FIR Number' AS field_name, 'case_reference' AS key, strftime(o_orderdate, '%m / %Y') AS value, strftime(o_orderdate, '%m%Y') AS norm FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 1, 'District', 'district', o_orderstatus, lower(o_orderstatus) FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 2, 'id:Priority  Code', 'identifier:priority code', o_orderpriority, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') FROM orders),
v AS (SELECT case_id, key, norm, arg_min(value, ord) AS value FROM o GROUP BY ALL),
f AS (SELECT case_id, key, count(*) AS n_values, list(value ORDER BY norm) AS vs FROM v GROUP BY case_id, key HAVING count(*) > 1),
c AS (SELECT case_id, key, n_values, 'CONTR-' || replace(replace(key, ':', '-'), ' ', '-') || '-' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY key) AS VARCHAR), 3, '0') AS contradiction_id,
  'Conflicting values observed for ''' || replace(key, '_', ' ') || ''': ' || array_to_string(vs[:20], ', ') || CASE WHEN n_values > 20 THEN ' and ' || (n_values - 20) || ' more' ELSE '' END AS message FROM f)"""


@query(f"""WITH {_CONFLICTS} SELECT c.case_id, contradiction_id, CASE WHEN key = 'case_reference' THEN 'IDENTIFIER_MISMATCH' ELSE 'FIELD_VALUE_CONFLICT' END AS type,
CASE WHEN key = 'case_reference' THEN 'high' ELSE 'medium' END AS severity, key, message, n_values, count(*) AS n_observations FROM c JOIN o USING (case_id, key) GROUP BY ALL""")
def contradiction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts within each customer's orders."""
    return review.contradiction_report(stored(review.observed(order_observations(spark, sf_dir)), "observed"))


@query(f"""WITH {_CONFLICTS} SELECT case_id, contradiction_id, row_number() OVER (PARTITION BY case_id, key ORDER BY 'order-' || ord, field_name, value, ord, pos) AS place, 'order-' || ord AS filename, field_name, value
FROM c JOIN o USING (case_id, key)""")
def contradiction_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the conflicts were observed in."""
    seen = stored(review.observed(order_observations(spark, sf_dir)), "observed")
    found = review.contradiction_observations(seen, stored(review.contradiction_report(seen), "conflicts"))
    return found.select("case_id", "contradiction_id", "place", "filename", "field_name", "value")


@query("""WITH o AS (SELECT l_orderkey AS id, l_suppkey, l_partkey, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT id, CAST(l_suppkey AS VARCHAR) AS value FROM o UNION SELECT id, CAST(l_partkey AS VARCHAR) FROM o UNION SELECT id, CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END FROM o
UNION SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN o ON id = o_orderkey UNION SELECT o_orderkey, o_orderpriority FROM orders SEMI JOIN o ON id = o_orderkey""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plain values of orders written as nested JSON."""
    line = F.struct(F.col("l_suppkey").alias("s"), F.array(F.array("l_partkey")).alias("p"), F.struct((F.col("l_discount") > 0.05).alias("cheap"), F.lit(None).cast("string").alias("none")).alias("more"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority").join(lines, "id")
    whole = F.to_json(F.struct("o_orderstatus", F.array(F.concat(F.lit(" "), "o_orderpriority"), F.lit("")).alias("tags"), "lines"), {"ignoreNullFields": "false"})
    return leaves.leaves(orders.select("id", whole.alias("value")), "value", "id")


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of their brand: the type and the size in a list are attributes."""
    attributes = F.create_map(F.lit("line"), F.col("p_type"), F.lit("sizes"), F.to_json(F.array("p_size")))
    none = F.lit(None).cast("string")
    parts = table(spark, sf_dir, "part").select(F.format_string("P%06d", F.col("p_partkey")).alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), none.alias("normalized_name"), none.alias("role"), attributes.alias("attributes"), (1 - F.col("p_size") / 100).alias("confidence"))
    return stored(parts, "part-entities")


@query()
def er_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand that may be one and the same, with signals and scores (matching blocks of characters: no SQL)."""
    found = resolution.candidates(part_entities(spark, sf_dir))
    return found.select("left_id", "right_id", "name", "strong", "attribute", "score", "status", F.array_join("reasons", ",").alias("reasons"))


@query()
def er_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all confirmed pairs of the parts."""
    found = resolution.resolved(part_entities(spark, sf_dir))
    return found.select("cluster", "canonical_id", F.array_join("aliases", ",").alias("aliases"), F.size("member_ids").alias("n_members"))


def order_cases(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each customer's orders as the documents of a case: reports, seizures and arrests by status, with a date, a number, a named person and an amount."""
    kind = F.when(F.col("o_orderstatus") == "F", "fir_report").when(F.col("o_orderstatus") == "O", "seizure_memo").otherwise("arrest_memo")
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("ord"), F.lit(0).alias("pos"), kind.alias("doc_type"), "o_orderdate", "o_orderpriority", "o_totalprice")
    docs = stored(docs, "case-documents")
    named = F.concat(F.lit("Mr. clerk "), F.substring("o_orderpriority", 3, 20))
    role = F.when((F.col("doc_type") == "arrest_memo") & F.col("o_orderpriority").startswith("1"), "accused").otherwise("witness")
    out = {
        "documents": docs.select("case_id", "document_id", "ord", "doc_type", F.lit(None).cast("double").alias("overall_confidence")),
        "dates": docs.select("case_id", "document_id", "doc_type", "ord", "pos", F.lit("on").alias("label"), F.date_format("o_orderdate", "'dated 'dd/MM/yyyy").alias("value")),
        "items": docs.select("case_id", "document_id", "ord", "pos", F.lit("Crime number").alias("type"), F.date_format("o_orderdate", "MM/yyyy").alias("value")),
        "money": crossdoc.case_ledger(docs.select("case_id", F.col("o_totalprice").alias("value"), F.lit("USD").alias("currency"), "ord")),
    }
    out["people"] = stored(crossdoc.persons(docs.select("case_id", "document_id", "ord", "pos", named.alias("name"), role.alias("role"))), "case-people")
    out["flags"] = stored(crossdoc.discrepancies(out["documents"], out["dates"], out["items"], out["people"]), "case-flags")
    return out


_CASES = """d AS (SELECT o_custkey AS case_id, CAST(o_orderkey AS VARCHAR) AS doc, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'fir_report' WHEN 'O' THEN 'seizure_memo' ELSE 'arrest_memo' END AS kind,
  o_orderdate AS day, o_orderpriority AS p, o_totalprice AS price FROM orders),
e AS (SELECT case_id, min(day) FILTER (kind = 'fir_report') AS r, min(day) FILTER (kind = 'seizure_memo') AS s, min(day) FILTER (kind = 'arrest_memo') AS a, bool_or(kind = 'arrest_memo' AND p LIKE '1%') AS accused FROM d GROUP BY case_id),
i AS (SELECT case_id, strftime(day, '%m/%Y') AS v, min(ord) AS ord FROM d GROUP BY ALL), j AS (SELECT case_id, string_agg(v, ', ' ORDER BY ord) AS vs FROM i GROUP BY case_id HAVING count(*) > 1),
flags AS (
  SELECT case_id, 'TEMPORAL_CONTRADICTION' AS flag, 'high' AS severity, 'FIR Report,Seizure Memo' AS documents, 'Seizure date (' || strftime(s, '%Y-%m-%d') || ') predates FIR registration date (' || strftime(r, '%Y-%m-%d')
    || '). Requires evidentiary justification under Sec 100/102 CrPC.' AS message FROM e WHERE s::DATE < r::DATE
  UNION ALL SELECT case_id, 'TEMPORAL_CONTRADICTION', 'high', 'FIR Report,Arrest Memo', 'Arrest date (' || strftime(a, '%Y-%m-%d') || ') predates FIR registration date (' || strftime(r, '%Y-%m-%d') || ').' FROM e WHERE a::DATE < r::DATE
  UNION ALL SELECT case_id, 'IDENTIFIER_MISMATCH', 'high', (SELECT string_agg(doc, ',' ORDER BY doc) FROM d WHERE d.case_id = j.case_id), 'Multiple conflicting FIR / Crime Numbers detected across documents: ' || vs FROM j
  UNION ALL SELECT case_id, 'MISSING_CORROBORATION', 'medium', 'Seizure Memo,Arrest Memo', 'No corroborated suspect or arrestee name linked across Seizure Memo and Arrest Memo.' FROM e WHERE s IS NOT NULL AND a IS NOT NULL AND NOT accused
)"""


@query(f"WITH {_CASES} SELECT * FROM flags")
def case_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents of each customer's case disagree."""
    found = order_cases(spark, sf_dir)["flags"]
    return found.select("case_id", "flag", "severity", F.array_join("documents", ",").alias("documents"), "message")


@query(f"""WITH {_CASES}, k AS (SELECT case_id, kind, count(*) AS n, min(ord) AS ord FROM d GROUP BY ALL),
t AS (SELECT case_id, sum(n) AS n, string_agg(n || ' ' || CASE kind WHEN 'fir_report' THEN 'Fir Report' WHEN 'seizure_memo' THEN 'Seizure Memo' ELSE 'Arrest Memo' END, ', ' ORDER BY ord) AS kinds FROM k GROUP BY case_id),
c AS (SELECT case_id, substr(p, 3) AS name, count(DISTINCT doc) AS n, min(ord) AS ord FROM d GROUP BY ALL),
b AS (SELECT case_id, 'Clerk ' || array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, length(name) DESC, ord) AS i FROM c),
q AS (SELECT case_id, string_agg(name, ', ' ORDER BY i) AS persons FROM b WHERE i <= 3 GROUP BY case_id), m AS (SELECT case_id, sum(price) AS total, count(*) AS items FROM d WHERE price > 0 GROUP BY case_id),
g AS (SELECT case_id, count(*) AS n_flags FROM flags GROUP BY case_id)
SELECT case_id, 0.9 AS confidence, 'Case Dossier containing ' || t.n || ' document(s) (' || kinds || '). Primary cross-document entities identified: ' || persons || '. Total financial/property ledger: USD ' || format('{{:,.2f}}', total)
  || ' across ' || items || ' itemized entries. Timeline spans ' || t.n || ' chronological event(s). ' || CASE WHEN n_flags > 0 THEN '⚠ ' || n_flags || ' cross-document discrepancy warning(s) detected requiring review.'
  ELSE '✓ Full cross-document evidentiary consistency verified (0 conflicting identifiers or dates).' END AS summary FROM t JOIN q USING (case_id) JOIN m USING (case_id) LEFT JOIN g USING (case_id)""")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few sentences about each customer's case."""
    c = order_cases(spark, sf_dir)
    return crossdoc.summaries(c["documents"], c["people"], c["dates"], c["money"], c["flags"]).select("case_id", "confidence", "summary")


@query("""WITH d AS (SELECT o_custkey AS case_id, regexp_replace(o_orderpriority, '^..', '') AS word, count(*) AS n_documents FROM orders GROUP BY ALL),
c AS (SELECT case_id, 'Clerk ' || array_to_string(list_transform(string_split(word, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS person, n_documents FROM d)
SELECT case_id, person, n_documents, row_number() OVER (PARTITION BY case_id ORDER BY n_documents DESC, person) AS rank FROM c QUALIFY rank <= 8""")
def dossier_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persons that the dossier of each case names: a report."""
    return display.dossier_persons(order_cases(spark, sf_dir)["people"]).select("case_id", "person", "n_documents", "rank")
