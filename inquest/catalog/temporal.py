"""Temporal and anomaly queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest import views
from inquest.catalog.registry import query
from inquest.operators import anomaly, findings, temporal
from inquest.operators.components import components
from inquest.storage import stored, table

TARGET = (dt.datetime(2024, 1, 24), dt.datetime(2024, 1, 31) - anomaly.MICRO)
BASELINE = (dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 24) - anomaly.MICRO)
#: For interactions of customers and suppliers.
YEAR = (dt.datetime(2000, 1, 1), dt.datetime(2000, 7, 1) - anomaly.MICRO)
YEAR_BEFORE = (dt.datetime(1995, 1, 1), dt.datetime(2000, 1, 1) - anomaly.MICRO)
QUARTER = (dt.datetime(1998, 1, 1), dt.datetime(1998, 4, 1) - anomaly.MICRO)
DAY_MINUTES, WIDE_MINUTES = 1440, 7200

USERS = "u AS (SELECT event_id, event_type, ts, CAST(user_id AS VARCHAR) AS entity_id FROM events)"
MET = """m AS (SELECT DISTINCT l_orderkey AS event_id, o_orderdate AS start_at, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def stamp(at: dt.datetime) -> str:
    return f"TIMESTAMP '{at}'"


def between(column: str, span: tuple) -> str:
    return f"{column} BETWEEN {stamp(span[0])} AND {stamp(span[1])}"


def lit(at: dt.datetime):
    return F.lit(at).cast("timestamp")


def bucketed(column: str, minutes: int) -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', {column}, TIMESTAMP '1970-01-01')"


def peak_sql(source: str, key: str, at: str, target: tuple, baseline: tuple, minutes: int) -> str:
    """SQL for the peaks of `source(key, event_id, at)`."""
    n = float(anomaly.n_buckets(baseline, minutes))
    return f"""
t AS (SELECT {key}, {bucketed(at, minutes)} AS b, count(DISTINCT event_id) AS n FROM {source} WHERE {between(at, target)} GROUP BY ALL),
p AS (SELECT {key}, b AS peak_start, n AS peak_count FROM t QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, b) = 1),
c AS (SELECT {key}, {bucketed(at, minutes)} AS b, count(DISTINCT event_id) AS n FROM {source} WHERE {between(at, baseline)} GROUP BY ALL),
s AS (SELECT {key}, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY ALL),
z AS (SELECT p.*, coalesce(s, 0) / {n} AS mean, sqrt(greatest(0, coalesce(q, 0) / {n} - (coalesce(s, 0) / {n}) * (coalesce(s, 0) / {n}))) AS std FROM p LEFT JOIN s USING ({key})),
f AS (SELECT *, greatest(0, least(1, (peak_count - mean) / (std + 1) / 3.0)) AS score FROM z)"""


SEVERITY = "CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS severity"


@query(f"""WITH {USERS}, {peak_sql("u", "entity_id", "ts", TARGET, BASELINE, 60)}
SELECT entity_id, peak_start, CAST(peak_count AS BIGINT) AS peak_count, round(mean, 6) AS baseline_mean, round(score, 6) AS score, {SEVERITY} FROM f WHERE score > 0""")
def activity_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose busiest hour of the target week lies above the week before."""
    found = anomaly.activity_spikes(views.user_events(spark, sf_dir), TARGET, BASELINE)
    return found.select("entity_id", F.col("peak_start").cast("timestamp_ntz"), "peak_count", F.round("baseline_mean", 6).alias("baseline_mean"), F.round("score", 6).alias("score"), "severity")


@query(f"SELECT event_id FROM events WHERE {between('ts', TARGET)}")
def events_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the target week."""
    return temporal.in_window(views.user_events(spark, sf_dir), lit(TARGET[0]), lit(TARGET[1])).select("event_id")


@query(f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE {between('ts', TARGET)}")
def active_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an event in the target week."""
    return temporal.active_entities(views.user_events(spark, sf_dir), lit(TARGET[0]), lit(TARGET[1]))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS entity_id, {bucketed('ts', 60)} AS bucket_start, count(*) AS event_count
FROM events WHERE {between('ts', TARGET)} GROUP BY ALL""")
def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and hour of the target week."""
    found = temporal.activity_buckets(views.user_events(spark, sf_dir), lit(TARGET[0]), lit(TARGET[1]))
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


OPEN = "o AS (SELECT o_orderkey, o_custkey, min(o_orderdate) AS a, max(l_shipdate) AS z FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events from the order date to the last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("timestamp").alias("end_at"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("start_at"), views.person("o_custkey").alias("source_entity_id"))
    joined = orders.join(last, "o_orderkey")
    return joined.select(F.col("o_orderkey").alias("event_id"), "start_at", "end_at", "source_entity_id", F.lit(None).cast("string").alias("target_entity_id"))


@query(f"""WITH {OPEN}, w AS (SELECT 'C' || o_custkey AS entity_id, greatest(a, {stamp(QUARTER[0])}) AS a, least(z, {stamp(QUARTER[1])}) AS z FROM o
  WHERE a <= z AND a <= {stamp(QUARTER[1])} AND z >= {stamp(QUARTER[0])}),
b AS (SELECT entity_id, unnest(generate_series({bucketed('a', WIDE_MINUTES)}, {bucketed('z', WIDE_MINUTES)}, INTERVAL '{WIDE_MINUTES} minutes')) AS bucket_start FROM w)
SELECT entity_id, bucket_start, count(*) AS event_count FROM b GROUP BY ALL""")
def interval_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders per customer and five-day bucket of a quarter."""
    found = temporal.activity_buckets(open_orders(spark, sf_dir).where("start_at <= end_at"), lit(QUARTER[0]), lit(QUARTER[1]), WIDE_MINUTES)
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query(f"WITH {OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS object_id, 'INVALID_EVENT_TIME' AS code FROM o WHERE a > z")
def interval_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose last shipment precedes the order date."""
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    attributes = F.create_map(F.lit("timestamp_start"), text("start_at"), F.lit("timestamp_end"), text("end_at"))
    nodes = open_orders(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.lit("ORDER").alias("type"), attributes.alias("attributes"))
    return temporal.dated_events(nodes)[1]


@query(f"""WITH {MET}, w AS (SELECT * FROM m WHERE {between('start_at', QUARTER)})
SELECT src AS node_id FROM w UNION SELECT dst FROM w UNION SELECT CAST(event_id AS VARCHAR) FROM w""")
def snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the network of a quarter."""
    return temporal.snapshot_nodes(views.interactions(spark, sf_dir), views.interaction_edges(spark, sf_dir), lit(QUARTER[0]), lit(QUARTER[1]))


@query(f"WITH {MET} SELECT event_id || '-' || dst AS edge_id FROM m WHERE {between('start_at', QUARTER)}")
def snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the network of a quarter."""
    return temporal.snapshot_edges(views.interactions(spark, sf_dir), views.interaction_edges(spark, sf_dir), lit(QUARTER[0]), lit(QUARTER[1]))


NEXT = (dt.datetime(1998, 4, 1), dt.datetime(1998, 7, 1) - anomaly.MICRO)


@query(f"""WITH {MET}, a AS (SELECT DISTINCT src, dst FROM m WHERE {between('start_at', QUARTER)}), z AS (SELECT DISTINCT src, dst FROM m WHERE {between('start_at', NEXT)})
(SELECT src, dst, 'NEW' AS change FROM z EXCEPT SELECT src, dst, 'NEW' FROM a) UNION ALL (SELECT src, dst, 'GONE' FROM a EXCEPT SELECT src, dst, 'GONE' FROM z)""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that came or went between two quarters."""
    edges = views.interaction_edges(spark, sf_dir)
    return temporal.delta(*(temporal.active_pairs(edges, lit(a), lit(z)) for a, z in (QUARTER, NEXT)))


def _in_snapshot(span: tuple) -> str:
    inside = f"m WHERE {between('start_at', span)}"
    return f"""SELECT 'PAIR' AS kind, src || ' ' || dst AS object_id FROM {inside} UNION SELECT 'EDGE', event_id || '-' || dst FROM {inside}
UNION SELECT 'NODE', src FROM {inside} UNION SELECT 'NODE', dst FROM {inside} UNION SELECT 'NODE', CAST(event_id AS VARCHAR) FROM {inside}"""


@query(f"""WITH {MET}, a AS ({_in_snapshot(QUARTER)}), z AS ({_in_snapshot(NEXT)})
SELECT kind, object_id, 'NEW' AS change FROM z ANTI JOIN a USING (kind, object_id) UNION ALL SELECT kind, object_id, 'GONE' FROM a ANTI JOIN z USING (kind, object_id)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges and pairs that came or went between two quarters."""
    events = stored(views.interactions(spark, sf_dir), "interactions")
    return temporal.snapshot_changes(events, views.interaction_edges(spark, sf_dir), *((lit(a), lit(z)) for a, z in (QUARTER, NEXT)))


KINDS = "b AS (SELECT event_id, ts, 'T-' || event_type AS src, CAST(user_id AS VARCHAR) AS dst FROM events)"


@query(f"""WITH {KINDS}, {peak_sql("b", "src, dst", "ts", TARGET, BASELINE, WIDE_MINUTES)}
SELECT dst AS src, src AS dst, peak_start, CAST(peak_count AS BIGINT) AS peak_count, round(score, 6) AS score, {SEVERITY} FROM f WHERE score > 0 AND peak_count >= 3""")
def user_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a burst of three or more events of a kind within five days."""
    events = views.user_events(spark, sf_dir).withColumn("target_entity_id", F.concat(F.lit("T-"), "event_type"))
    found = anomaly.interaction_bursts(events, TARGET, BASELINE, WIDE_MINUTES)
    return found.select("src", "dst", F.col("peak_start").cast("timestamp_ntz"), "peak_count", F.round("score", 6).alias("score"), "severity")


MOMENT = dt.datetime(1998, 2, 1)


@query(f"WITH {OPEN} SELECT o_orderkey AS event_id FROM o WHERE a <= z AND {stamp(MOMENT)} BETWEEN a AND z")
def point_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open at an instant."""
    return temporal.in_window(open_orders(spark, sf_dir).where("start_at <= end_at"), lit(MOMENT), lit(MOMENT)).select("event_id")


NOVEL = f"""{MET}, n AS (SELECT src, dst, count(*) AS n FROM m WHERE {between('start_at', YEAR)} GROUP BY ALL),
o AS (SELECT DISTINCT src, dst FROM m WHERE {between('start_at', YEAR_BEFORE)}), x AS (SELECT n.* FROM n ANTI JOIN o USING (src, dst))"""


@query(f"WITH {NOVEL}, f AS (SELECT *, least(1.0, n / 2.0) AS score FROM x) SELECT src, dst, n AS target_count, score, {SEVERITY} FROM f")
def novel_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that first meet in the target half-year."""
    return anomaly.novel_relationships(stored(views.interactions(spark, sf_dir), "interactions"), YEAR, YEAR_BEFORE)


@query(f"""WITH {MET}, {peak_sql("m", "src, dst", "start_at", YEAR, YEAR_BEFORE, WIDE_MINUTES)}
SELECT src, dst, peak_start, CAST(peak_count AS BIGINT) AS peak_count, round(score, 6) AS score, {SEVERITY} FROM f WHERE score > 0 AND peak_count >= 1""")
def interaction_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs' busiest five days of the half-year against the years before (with any number of events: bursts of three are rare here)."""
    met = stored(views.interactions(spark, sf_dir), "interactions")
    found = anomaly.peaks(anomaly.by_pair(met), ["src", "dst"], YEAR, YEAR_BEFORE, WIDE_MINUTES).where("score > 0")
    return found.select("src", "dst", F.col("peak_start").cast("timestamp_ntz"), "peak_count", F.round("score", 6).alias("score"), anomaly.severity(F.col("score")).alias("severity"))


MONTH_BEFORE = (dt.datetime(1999, 12, 1), dt.datetime(2000, 1, 1) - anomaly.MICRO)


@query(f"""WITH RECURSIVE {MET}, o AS (SELECT DISTINCT src, dst FROM m WHERE {between('start_at', MONTH_BEFORE)}),
e AS (SELECT src AS a, dst AS b FROM o UNION SELECT dst, src FROM o), n AS (SELECT src AS a FROM m UNION SELECT dst FROM m),
r(a, b) AS (SELECT a, a FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS part FROM r GROUP BY a),
t AS (SELECT src, dst, count(*) AS n FROM m WHERE {between('start_at', YEAR)} GROUP BY ALL)
SELECT t.src, t.dst, x.part AS src_component, y.part AS dst_component, t.n AS target_count, round(0.5 + 0.5 * t.n / (t.n + 1.0), 6) AS score
FROM t JOIN c x ON t.src = x.a JOIN c y ON t.dst = y.a ANTI JOIN o USING (src, dst) WHERE x.part <> y.part""")
def cross_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the half-year between components of the network of the month before."""
    events = stored(views.interactions(spark, sf_dir), "interactions")
    old = anomaly.pair_totals(events, MONTH_BEFORE)
    parts = components(old.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    nodes = events.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("node_id")).distinct()
    members = nodes.join(parts.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    found = anomaly.cross_community(events, members, YEAR, MONTH_BEFORE)
    return found.select("src", "dst", "src_component", "dst_component", "target_count", F.round("score", 6).alias("score"))


@query(f"""WITH {USERS}, {peak_sql("u", "entity_id", "ts", TARGET, BASELINE, 60)}, g AS (SELECT *, round(score, 12) AS r FROM f WHERE score > 0),
k AS (SELECT *, row_number() OVER (ORDER BY r DESC, entity_id) AS n FROM g QUALIFY n <= 100)
SELECT 'ANOM_' || lpad(CAST(n AS VARCHAR), 4, '0') AS finding_id, 'ACTIVITY_SPIKE' AS anomaly_type, entity_id, CAST(peak_count AS BIGINT) AS event_count, round(r, 6) AS score,
  CASE WHEN r >= 0.8 THEN 'HIGH' WHEN r >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'INVESTIGATIVE_LEAD' AS status FROM k""")
def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred leads about users: a ranked report."""
    spikes = anomaly.activity_spikes(views.user_events(spark, sf_dir), TARGET, BASELINE)
    title = F.concat(F.lit("Unusual activity spike for "), "entity_id")
    found = anomaly.ranked(anomaly.as_findings(spikes, "ACTIVITY_SPIKE", "peak_count", title))
    return found.select("finding_id", "anomaly_type", "entity_id", "event_count", F.round("score", 6).alias("score"), "severity", "status")


_ENDS = "ends AS (SELECT event_id, start_at, src AS entity_id FROM m UNION ALL SELECT event_id, start_at, dst FROM m)"
#: Findings of four detectors over the interactions; the fifth needs centralities of one half, which no node of this network has.
_REPORT = f"""RECURSIVE {MET}, {_ENDS}, old AS (SELECT DISTINCT src, dst FROM m WHERE {between('start_at', MONTH_BEFORE)}),
e AS (SELECT src AS a, dst AS b FROM old UNION SELECT dst, src FROM old), v AS (SELECT DISTINCT entity_id AS a FROM ends),
r(a, b) AS (SELECT a, a FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), part AS (SELECT a, min(b) AS part FROM r GROUP BY a),
names AS (SELECT a, dense_rank() OVER (ORDER BY part) AS i FROM part), comp AS (SELECT a, 'BASE_COMM_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS comp FROM names),
fresh AS (SELECT src, dst, count(*) AS n FROM m WHERE {between('start_at', YEAR)} GROUP BY ALL), novel AS (SELECT * FROM fresh ANTI JOIN old USING (src, dst)),
spikes AS (WITH {peak_sql("ends", "entity_id", "start_at", YEAR, MONTH_BEFORE, WIDE_MINUTES)} SELECT * FROM f WHERE score > 0),
bursts AS (WITH {peak_sql("m", "src, dst", "start_at", YEAR, MONTH_BEFORE, WIDE_MINUTES)} SELECT * FROM f WHERE score > 0 AND peak_count >= 3),
every AS (
  SELECT 'ACTIVITY_SPIKE' AS anomaly_type, entity_id, NULL AS source_entity_id, NULL AS target_entity_id, score, 'Unusual activity spike for ' || entity_id AS title,
    'Activity reached ' || peak_count || ' event(s) in one {WIDE_MINUTES}-minute bucket, versus a baseline mean of ' || printf('%.2f', mean) || '.' AS explanation, peak_start FROM spikes
  UNION ALL SELECT 'NOVEL_RELATIONSHIP', NULL, src, dst, least(1.0, n / 2.0), 'New interaction detected: ' || src || ' ↔ ' || dst,
    'The pair has ' || n || ' time-stamped interaction event(s) in the target window and no time-stamped interaction events in the baseline window.', NULL FROM novel
  UNION ALL SELECT 'INTERACTION_BURST', NULL, src, dst, score, 'Unusual interaction burst', 'The relationship produced ' || peak_count || ' event(s) in one {WIDE_MINUTES}-minute bucket, versus a baseline mean of ' || printf('%.2f', mean) || '.', peak_start FROM bursts
  UNION ALL SELECT 'CROSS_COMMUNITY_ACTIVITY', NULL, src, dst, 0.5 + 0.5 * n / (n + 1.0), 'New cross-community interaction', 'The target window introduces a new interaction between baseline components ' || x.comp || ' and ' || y.comp || '.', NULL
    FROM novel JOIN comp x ON src = x.a JOIN comp y ON dst = y.a WHERE x.comp <> y.comp
), top AS (
  SELECT *, round(CAST(score AS DOUBLE), 12) AS s, row_number() OVER (ORDER BY round(CAST(score AS DOUBLE), 12) DESC, anomaly_type, coalesce(entity_id, source_entity_id), coalesce(target_entity_id, ''), title) AS n FROM every QUALIFY n <= 100
)"""


def interaction_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = stored(views.interactions(spark, sf_dir), "interactions")
    nodes = events.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    return findings.report(nodes, events, YEAR, MONTH_BEFORE, WIDE_MINUTES), events


@query(f"""WITH {_REPORT} SELECT 'ANOM_' || lpad(CAST(n AS VARCHAR), 4, '0') AS finding_id, anomaly_type, entity_id, source_entity_id, target_entity_id, round(s, 6) AS score,
CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS severity, title, explanation FROM top""")
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred leads of all detectors about the half-year, in words: a ranked report."""
    found, _ = interaction_findings(spark, sf_dir)
    return found.select("finding_id", "anomaly_type", "entity_id", "source_entity_id", "target_entity_id", F.round("score", 6).alias("score"), "severity", "title", "explanation")


@query(f"""WITH {_REPORT}, inside AS (SELECT *, {bucketed('start_at', WIDE_MINUTES)} AS b FROM m WHERE {between('start_at', YEAR)})
SELECT DISTINCT 'ANOM_' || lpad(CAST(n AS VARCHAR), 4, '0') AS finding_id, 'EVENT' AS object_type, CAST(event_id AS VARCHAR) AS object_id FROM top JOIN inside
  ON (entity_id IN (src, dst) OR (source_entity_id = src AND target_entity_id = dst)) AND (peak_start IS NULL OR peak_start = b)
UNION SELECT 'ANOM_' || lpad(CAST(n AS VARCHAR), 4, '0'), 'RELATIONSHIP', event_id || '-' || dst FROM top JOIN m ON source_entity_id = src AND target_entity_id = dst""")
def findings_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events and relationships that these leads rest on."""
    found, events = interaction_findings(spark, sf_dir)
    return findings.support(found, events, views.interaction_edges(spark, sf_dir), YEAR, WIDE_MINUTES)
