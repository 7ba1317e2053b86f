"""Queries over recorded model outputs and texts, derived from the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.catalog.registry import query
from inquest.functions import mining
from inquest.operators import extraction
from inquest.storage import table

#: A recorded output for each order, in one of six shapes: items, objects with fences and stray commas, cut off, with bad values, of a wrong type, prose.
OUTPUTS = """CASE o_orderkey % 6
WHEN 0 THEN '{"document_type": "Tax Invoice", "parties": [{"name": "C-' || o_custkey || '", "role": "buyer", "confidence": 0.92}], "dates": [{"label": "ordered", "value": "' || day || '", "confidence": 0.88, "bounding_box": {"x": 10, "y": 20, "w": 30}}], "amounts": [{"label": "total", "value": ' || price || ', "currency": "USD", "confidence": 0.95}], "identifiers": [{"type": "order", "value": "O-' || o_orderkey || '"}], "raw_text": "An order of high priority", "overall_confidence": 0.91}'
WHEN 1 THEN 'The result:\n```json\n{"document_type": "deed", "parties": {"buyer": "C-' || o_custkey || '",}, "dates": {"ordered": {"value": "' || day || '", "confidence": 0.5,},}, "amounts": {"total": "$' || price || '"}, "identifiers": {"order": "O-' || o_orderkey || '", "status": null, "units": 7}, "raw_text": "An order of high priority",}\n```\nDone.'
WHEN 2 THEN '{"document_type": "receipt", "raw_text": "An order of high priority", "parties": ["C-' || o_custkey || '"], "dates": ["' || day || '"], "amounts": [' || price || ', "7.5"], "identifiers": [{"label": "order", "value": "O-' || o_orderkey || '"}, '
WHEN 3 THEN '{"document_type": 7, "parties": [{"name": "C-' || o_custkey || '", "confidence": 1.5}, {"value": "Clerk", "role": "clerk"}], "dates": [{"value": "' || day || '", "confidence": null}], "amounts": [{"value": "USD ' || price || '"}], "identifiers": [{"key": "order", "value": ' || o_orderkey || '}], "raw_text": "An order of high priority", "overall_confidence": "0.8"}'
WHEN 4 THEN '{"dates": "yesterday", "parties": ["C-' || o_custkey || '"], "raw_text": "An order of high priority"}'
ELSE 'Complainant: Anna Lee; FIR No: ' || o_orderkey || '/1997; on ' || day || ' Rs. ' || price || ' was taken by Accused: K ' || o_custkey || ';' END"""
_FIELDS = """WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, printf('%.2f', o_totalprice) AS price, o_orderkey % 6 AS k FROM orders),
kinds(k, document_type) AS (VALUES (0, 'invoice'), (1, 'contract'), (2, 'receipt'), (3, 'contract'), (4, 'other'), (5, 'fir_report')),
f(k, pos, field_name, said, confidence) AS (VALUES
(0, 0, 'party:buyer_1', 'C-', 0.92), (0, 1, 'date:ordered', 'day', 0.88), (0, 2, 'amount:total (USD)', 'price', 0.95), (0, 3, 'id:order', 'O-', 0.9), (0, 4, 'summary:incident_description', 'An order of high priority', 0.91),
(1, 0, 'party:buyer_1', 'C-', 0.9), (1, 1, 'date:ordered', 'day', 0.5), (1, 2, 'amount:total (INR)', 'price', 0.9), (1, 3, 'id:order', 'O-', 0.9), (1, 4, 'id:units', '7', 0.9), (1, 5, 'summary:incident_description', 'An order of high priority', 0.9),
(2, 0, 'party:party_1', 'C-', 0.9), (2, 1, 'date:date', 'day', 0.9), (2, 2, 'amount:amount (INR)', 'price', 0.9), (2, 3, 'amount:amount (INR)', '7.50', 0.9), (2, 4, 'id:order', 'O-', 0.9), (2, 5, 'summary:incident_description', 'An order of high priority', 0.9),
(3, 0, 'party:clerk_1', 'Clerk', 0.9), (3, 1, 'date:Date_1', 'day', 0.85), (3, 2, 'amount:amount (INR)', 'price', 0.9), (3, 3, 'id:order', 'key', 0.9), (3, 4, 'summary:incident_description', 'An order of high priority', 0.8),
(4, 0, 'summary:incident_description', 'An order of high priority', 0.8), (4, 1, 'notes:legibility_assessment', 'Extracted via forensic heuristic recovery engine', 1.0),
(5, 0, 'party:complainant_1', 'Anna Lee', 0.85), (5, 1, 'party:accused_2', 'K', 0.85), (5, 2, 'date:Date_1', 'day', 0.85), (5, 3, 'amount:Property Value / Stated Amount (INR)', 'price', 0.85), (5, 4, 'id:FIR Number', 'key/1997', 0.85),
(5, 5, 'summary:incident_description', 'text', 0.8), (5, 6, 'notes:legibility_assessment', 'Extracted via forensic heuristic recovery engine', 1.0))
SELECT o_orderkey AS document_id, document_type, pos::INTEGER AS pos, field_name, CASE said WHEN 'C-' THEN 'C-' || o_custkey WHEN 'O-' THEN 'O-' || o_orderkey WHEN 'day' THEN day WHEN 'price' THEN price WHEN 'key' THEN o_orderkey::VARCHAR
 WHEN 'K' THEN 'K ' || o_custkey WHEN 'key/1997' THEN o_orderkey || '/1997' WHEN 'text' THEN 'Complainant: Anna Lee; FIR No: ' || o_orderkey || '/1997; on ' || day || ' Rs. ' || price || ' was taken by Accused: K ' || o_custkey || ';' ELSE said END AS field_value, confidence::DOUBLE AS confidence
FROM o JOIN kinds USING (k) JOIN f USING (k)"""


def recorded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text: a model output for each order."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("price", F.format_string("%.2f", F.col("o_totalprice")))
    return orders.select(F.col("o_orderkey").alias("document_id"), F.expr(OUTPUTS).alias("text"))


@query(_FIELDS)
def extraction_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the recorded outputs, read by schema or mined."""
    return extraction.fields(extraction.extracted(recorded_outputs(spark, sf_dir)), "document_id", "document_type").drop("bounding_box")


@query("""SELECT o_orderkey AS document_id, section, position, code FROM orders JOIN (VALUES (3, 'parties', 1, 'BAD_CONFIDENCE'), (3, 'dates', 1, 'BAD_CONFIDENCE'), (4, 'dates', NULL, 'WRONG_TYPE'), (5, 'document', NULL, 'NOT_JSON')) i(k, section, position, code) ON o_orderkey % 6 = k""")
def extraction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the recorded outputs."""
    return extraction.issues(extraction.extracted(recorded_outputs(spark, sf_dir)), "document_id")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: A heading in set phrases before each text, so that phrases occur whatever the text says.
STATED = """'Complainant Name: Ana ' || lang || ';\nFIR No: ' || doc_id || '/2024; Invoice #: V-' || doc_id || '; Rs. ' || n_chars || '.50 on 01/02/2024; {"name": "Bo ' || source || '", "role": "clerk"}, {"type": "pan", "value": "P' || doc_id || '"};\n' || coalesce(text, '')"""
# The phrase that looks ahead has no counterpart in this SQL's patterns; what follows the name is matched there instead.
_PATTERNS = [("party", role, p.replace("(?=", "(?:")) for role, several in mining.PARTIES.items() for p in several] + [("identifier", label, p) for label, p in mining.IDENTIFIERS.items()]
_MINED = rf"""WITH d AS (SELECT doc_id, {STATED} AS text FROM documents),
p(kind, n, label, pattern) AS (VALUES {", ".join(f"({_text(k)}, {i}, {_text(label)}, {_text('(?i)' + p)})" for i, (k, label, p) in enumerate(_PATTERNS))}),
lists AS (SELECT doc_id, kind, n, label, 0.85 AS confidence, regexp_extract_all(text, pattern, 1) AS l FROM d, p),
pieces AS (
  SELECT doc_id, kind, n, label, confidence, generate_subscripts(l, 1) AS place, trim(trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)), '.,;:"''') AS value FROM lists
  UNION ALL SELECT doc_id, 'party', 100, unnest(regexp_extract_all(text, '\{{\s*"name"\s*:\s*"[^"]+"\s*,\s*"role"\s*:\s*"([^"]+)"', 1)), 0.9, 1, unnest(regexp_extract_all(text, '\{{\s*"name"\s*:\s*"([^"]+)"\s*,\s*"role"', 1)) FROM d
  UNION ALL SELECT doc_id, 'identifier', 100, unnest(regexp_extract_all(text, '\{{\s*"type"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*"[^"]+"', 1)), 0.9, 1, unnest(regexp_extract_all(text, '\{{\s*"type"\s*:\s*"[^"]+"\s*,\s*"value"\s*:\s*"([^"]+)"', 1)) FROM d
), kept AS (
  SELECT * FROM pieces WHERE length(value) >= CASE WHEN kind = 'party' AND n < 100 THEN 3 ELSE 2 END AND NOT (kind = 'party' AND n < 100 AND regexp_matches(lower(value), 'police|station|report|subject'))
  QUALIFY row_number() OVER (PARTITION BY doc_id, kind, lower(value) ORDER BY n, place) = 1
), dates AS (SELECT doc_id, regexp_extract_all(text, '\b(\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}})\b', 1)[:5] AS l FROM d)
SELECT doc_id, CASE kind WHEN 'party' THEN 'parties' ELSE 'identifiers' END AS section, label, value, confidence::DOUBLE AS confidence FROM kept
UNION ALL SELECT doc_id, 'dates', 'Date_' || generate_subscripts(l, 1), unnest(l), 0.85 FROM dates
UNION ALL SELECT doc_id, 'amounts', 'INR', printf('%.2f', replace(x, ',', '')::DOUBLE), 0.85 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:rs\.?|inr|₹|\$)\s*([\d,]+(?:\.\d{{2}})?)', 1)) AS x FROM d) WHERE replace(x, ',', '') <> ''"""


@query(_MINED)
def mined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the documents state in set phrases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mining.mined(F.expr(STATED)).alias("m"))
    row = lambda section, label, value, x: F.struct(F.lit(section).alias("section"), label.alias("label"), value.alias("value"), x["confidence"].alias("confidence"))
    every = F.concat(
        F.transform("m.parties", lambda x: row("parties", x["role"], x["name"], x)),
        F.transform("m.identifiers", lambda x: row("identifiers", x["type"], x["value"], x)),
        F.transform("m.dates", lambda x: row("dates", x["label"], x["value"], x)),
        F.transform("m.amounts", lambda x: row("amounts", x["currency"], F.format_string("%.2f", x["value"]), x)),
    )
    return docs.select("doc_id", F.inline(every))
