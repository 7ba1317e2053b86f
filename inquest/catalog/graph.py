"""Queries over the network of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest import views
from inquest.catalog.registry import query
from inquest.catalog.temporal import WIDE_MINUTES, YEAR, YEAR_BEFORE
from inquest.operators import anomaly, centrality, communities as roles, paths, projection
from inquest.operators.components import components
from inquest.plans import workflow
from inquest.storage import stored, table

MET = "m AS (SELECT DISTINCT l_orderkey AS event_id, o_orderstatus AS status, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
WAYS = "e AS (SELECT src AS a, dst AS b, weight FROM g UNION ALL SELECT dst, src, weight FROM g), v AS (SELECT DISTINCT a FROM e)"
#: All pairs, their two directions and their nodes.
NETWORK = f"{MET}, g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY ALL), {WAYS}"
#: The same of the pairs with two orders or more.
REPEATED = f"{MET}, g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY ALL HAVING count(*) >= 2), {WAYS}"
#: Rounds of the SQL that walks step by step; no two nodes of the shared tables are further apart.
STEPS = 12


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(views.order_pairs(spark, sf_dir), "order-pairs")


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(views.repeat_pairs(spark, sf_dir), "repeat-pairs")


def _walk_sql(graph: str, start: str, steps: int) -> str:
    """k(s, t, d): the distances from the start nodes, a step at a time."""
    parts = [f"{graph}, k0 AS MATERIALIZED (SELECT a AS s, a AS t, 0 AS d FROM v WHERE {start})"]
    for i in range(steps):
        near = f"SELECT DISTINCT k{i}.s, e.b AS t, {i + 1} AS d FROM k{i} JOIN e ON k{i}.t = e.a WHERE k{i}.d = {i}"
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL SELECT x.* FROM ({near}) x ANTI JOIN k{i} ON x.s = k{i}.s AND x.t = k{i}.t)")
    return f"WITH {', '.join(parts)}, k AS (SELECT * FROM k{steps})"


def _parts_sql(graph: str) -> str:
    parts = [f"{graph}, l0 AS MATERIALIZED (SELECT a, a AS label FROM v)"]
    for i in range(STEPS):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT e.a, least(min(x.label), any_value(y.label)) AS label FROM e JOIN l{i} x ON e.b = x.a JOIN l{i} y ON e.a = y.a GROUP BY e.a)")
    return f"WITH {', '.join(parts)}"


@query(f"""WITH {MET} SELECT src, dst, round(CAST(count(*) AS DOUBLE) + CAST(0.05 AS DOUBLE) * count(*) FILTER (WHERE status = 'F'), 6) AS weight,
array_to_string(list_sort(list('R' || event_id || '-' || dst) FILTER (WHERE status = 'F')), ',') AS relationship_ids, array_to_string(list_sort(list(CAST(event_id AS VARCHAR))), ',') AS event_ids
FROM m GROUP BY src, dst""")
def pair_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with weight and support: every order is an event, every finished one a weak relationship too."""
    events = views.interactions(spark, sf_dir).withColumn("confidence", F.lit(0.0))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    edges = events.join(done, "event_id", "left_semi").select(
        F.concat(F.lit("R"), F.col("event_id").cast("string"), F.lit("-"), "target_entity_id").alias("edge_id"), F.col("source_entity_id").alias("source_id"), F.col("target_entity_id").alias("target_id"), F.lit(0.01).alias("confidence")
    )
    found = projection.pairs(edges, events)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return found.select("src", "dst", F.round("weight", 6).alias("weight"), joined("relationship_ids"), joined("event_ids"))


@query(f"""WITH {NETWORK} SELECT a AS node_id, count(*) AS degree, sum(weight) AS weighted_degree, round(count(*) / (SELECT greatest(1, count(*) - 1) FROM v), 6) AS degree_centrality FROM e GROUP BY a""")
def degree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in the network."""
    g = network(spark, sf_dir)
    return projection.degrees(g, views.pair_nodes(g)).withColumn("degree_centrality", F.round("degree_centrality", 6))


@query(f"WITH {NETWORK} SELECT 'C' || c_custkey AS node_id FROM customer EXCEPT SELECT src FROM g")
def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    ids = table(spark, sf_dir, "customer").select(views.person("c_custkey").alias("node_id")).distinct()
    return projection.isolates(network(spark, sf_dir), ids)


SEED = "(SELECT min(dst) FROM g)"


def seed(g: DataFrame) -> str:
    return g.agg(F.min("dst")).first()[0]


@query(f"WITH {NETWORK} SELECT DISTINCT b AS node_id FROM e WHERE a = {SEED}")
def neighbors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one supplier."""
    g = network(spark, sf_dir)
    return projection.both_ways(g).where(F.col("node_id") == seed(g)).select(F.col("neighbor_id").alias("node_id")).distinct()


@query(f"WITH {NETWORK} SELECT src, dst, weight FROM g WHERE src = {SEED} OR dst = {SEED}")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one supplier."""
    g = network(spark, sf_dir)
    return g.where((F.col("src") == seed(g)) | (F.col("dst") == seed(g)))


@query(f"WITH {NETWORK} SELECT m.event_id, m.src, m.dst FROM m JOIN (SELECT src, dst FROM g ORDER BY weight DESC, src, dst LIMIT 1) USING (src, dst)")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders between the two nodes of the strongest pair."""
    one = projection.strongest(network(spark, sf_dir), 1).first()
    found = views.interactions(spark, sf_dir).where((F.col("source_entity_id") == one.src) & (F.col("target_entity_id") == one.dst))
    return found.select("event_id", F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"))


@query(f"""WITH {NETWORK} SELECT g.* FROM g JOIN customer ON src = 'C' || c_custkey JOIN supplier ON dst = 'S' || s_suppkey WHERE c_nationkey < 12 AND s_nationkey < 12""")
def scoped_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs inside some nations."""
    people = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(views.person("c_custkey").alias("node_id"))
    firms = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(views.organization("s_suppkey").alias("node_id"))
    return projection.scoped(network(spark, sf_dir), people.unionByName(firms))


@query(f"WITH {NETWORK} SELECT a AS node_id, array_to_string(list_sort(list(DISTINCT b)), ',') AS neighbors FROM e GROUP BY a")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted neighbours of every node."""
    return projection.adjacency(network(spark, sf_dir)).withColumn("neighbors", F.array_join("neighbors", ","))


@query(f"{_parts_sql(NETWORK)} SELECT a AS node_id, label AS component FROM l{STEPS}")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the network by least member."""
    return components(network(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "node_id")


@query(f"{_walk_sql(NETWORK, f'a = {SEED}', 3)} SELECT t AS node_id, d AS hop FROM k")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three steps of one supplier."""
    g = network(spark, sf_dir)
    return paths.hops(g, spark.createDataFrame([(seed(g),)], "node_id string"), 3)


@query(f"{_walk_sql(NETWORK, f'a = {SEED}', STEPS)} SELECT t AS node_id, d AS distance FROM k")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from one supplier to all nodes in reach."""
    g = network(spark, sf_dir)
    return paths.search(g, seed(g)).select("node_id", "distance")


def _ranks_of(rounds: int) -> list[str]:
    """r0 and on: PageRank after each round."""
    parts = ["q AS (SELECT a, count(*) AS deg FROM e GROUP BY a), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), r0 AS (SELECT a, 1 / c.n AS r FROM v, c)"]
    for i in range(rounds):
        got = f"(SELECT e.b AS a, sum(r{i}.r / q.deg) AS s FROM r{i} JOIN q USING (a) JOIN e USING (a) GROUP BY e.b)"
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.a, 0.15 / c.n + 0.85 * coalesce(x.s, 0) AS r FROM v LEFT JOIN {got} x USING (a), c)")
    return parts


@query(f"WITH {NETWORK}, {', '.join(_ranks_of(20))} SELECT a AS node_id, round(r, 6) AS pagerank FROM r20")
def pagerank_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rounds of PageRank on the network."""
    g = network(spark, sf_dir)
    return centrality.pagerank(g, views.pair_nodes(g), rounds=20, tolerance=0).withColumn("pagerank", F.round("pagerank", 6))


def _between_sql(graph: str, steps: int) -> str:
    """u(a, owed): for each node the shares of shortest paths between all others that lead through it, both directions; paths are counted level by level out and summed up on the way back."""
    parts = [_walk_sql(graph, "true", steps), "p0 AS MATERIALIZED (SELECT s, t, CAST(1 AS DOUBLE) AS w FROM k0)"]
    for i in range(steps):
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT p.s, k.t, sum(p.w) AS w FROM p{i} p JOIN e ON e.a = p.t JOIN k ON k.s = p.s AND k.t = e.b AND k.d = {i + 1} GROUP BY p.s, k.t)")
    parts.append(f"o{steps} AS MATERIALIZED (SELECT s, t, w, CAST(0 AS DOUBLE) AS o FROM p{steps})")
    for i in range(steps - 1, 0, -1):
        got = f"SELECT c.s, e.b AS t, sum((1 + c.o) / c.w) AS x FROM o{i + 1} c JOIN e ON e.a = c.t GROUP BY ALL"
        parts.append(f"o{i} AS MATERIALIZED (SELECT p.s, p.t, p.w, coalesce(p.w * x.x, 0) AS o FROM p{i} p LEFT JOIN ({got}) x USING (s, t))")
    every = " UNION ALL ".join(f"SELECT t, o FROM o{i}" for i in range(1, steps + 1))
    return f"{', '.join(parts)}, u AS (SELECT t AS a, sum(o) AS owed FROM ({every}) GROUP BY t), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)"


BETWEEN = "SELECT v.a AS node_id, round(coalesce(owed, 0) / ((n - 1) * (n - 2)), 6) AS betweenness_centrality FROM v LEFT JOIN u USING (a), n"


@query(f"""{_walk_sql(REPEATED, 'true', STEPS)}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)
SELECT s AS node_id, round(power(count(*) - 1, 2) / sum(d) / any_value(n.n - 1), 6) AS closeness_centrality FROM k, n GROUP BY s""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness on the repeat pairs."""
    g = repeated(spark, sf_dir)
    return centrality.path_centralities(g, views.pair_nodes(g)).select("node_id", F.round("closeness_centrality", 6).alias("closeness_centrality"))


@query(f"{_between_sql(NETWORK, 4)} {BETWEEN}")
def betweenness_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness on all pairs; no two nodes are further apart than four steps."""
    g = network(spark, sf_dir)
    return centrality.path_centralities(g, views.pair_nodes(g)).select("node_id", F.round("betweenness_centrality", 6).alias("betweenness_centrality"))


@query(f"{_between_sql(REPEATED, STEPS)} {BETWEEN}")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness on the repeat pairs."""
    g = repeated(spark, sf_dir)
    return centrality.path_centralities(g, views.pair_nodes(g)).select("node_id", F.round("betweenness_centrality", 6).alias("betweenness_centrality"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the repeat pairs (sequential by definition: no SQL)."""
    g = repeated(spark, sf_dir)
    return roles.communities(g, views.pair_nodes(g))


def _removal_sql() -> str:
    """h(x, groups): for each node x the parts that its neighbours fall into once it is removed, numbered among all parts of what is left."""
    parts = ["c0 AS MATERIALIZED (SELECT x.a AS x, y.a, y.a AS label FROM v x JOIN v y ON x.a <> y.a)"]
    for i in range(STEPS):
        near = f"SELECT c.x, e.a, min(c.label) AS label FROM c{i} c JOIN e ON e.b = c.a WHERE e.a <> c.x GROUP BY ALL"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.x, c.a, least(c.label, coalesce(n.label, c.label)) AS label FROM c{i} c LEFT JOIN ({near}) n USING (x, a))")
    parts.append(f"numbers AS (SELECT x, label, row_number() OVER (PARTITION BY x ORDER BY label) AS i FROM (SELECT DISTINCT x, label FROM c{STEPS}))")
    parts.append(f"h AS (SELECT x, list_sort(list(DISTINCT 'LOCAL_' || x || '_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END)) AS groups FROM c{STEPS} c JOIN e ON e.a = c.x AND e.b = c.a JOIN numbers USING (x, label) GROUP BY x)")
    return ", ".join(parts)


@query(f"""{_between_sql(REPEATED, STEPS)}, {_removal_sql()} SELECT x AS node_id, len(groups) AS n_parts, array_to_string(groups, ',') AS neighbor_groups,
round(least(1, 0.65 * coalesce(owed, 0) / ((n - 1) * (n - 2)) + 0.35), 6) AS bridge_score FROM h LEFT JOIN u ON u.a = x, n WHERE len(groups) > 1""")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that hold the repeat pairs together."""
    g = repeated(spark, sf_dir)
    found = roles.bridges(g, centrality.path_centralities(g, views.pair_nodes(g)))
    return found.select("node_id", "n_parts", F.array_join("neighbor_groups", ",").alias("neighbor_groups"), F.round("bridge_score", 6).alias("bridge_score"))


def metrics(g: DataFrame, ids: DataFrame) -> DataFrame:
    """All centralities of a graph."""
    return projection.degrees(g, ids).join(centrality.path_centralities(g, ids), "node_id").join(centrality.pagerank(g, ids), "node_id")


@query(f"""{_between_sql(REPEATED, STEPS)}, {', '.join(_ranks_of(100))},
near AS (SELECT s AS a, power(count(*) - 1, 2) / sum(d) / any_value(n.n - 1) AS close FROM k, n GROUP BY s),
x AS (SELECT v.a, round(q.deg / greatest(1, n.n - 1), 12) AS deg, round(coalesce(owed, 0) / ((n.n - 1) * (n.n - 2)), 12) AS btw, round(close, 12) AS clo, round(r100.r, 12) AS pr
  FROM v JOIN q USING (a) JOIN near USING (a) JOIN r100 USING (a) LEFT JOIN u USING (a), n),
y AS (SELECT *, 0.25::DOUBLE * deg + 0.35::DOUBLE * btw + 0.15::DOUBLE * clo + 0.25::DOUBLE * pr AS influence FROM x), z AS (SELECT *, influence / (SELECT max(influence) FROM y) AS share, (SELECT avg(pr) FROM y) AS mean FROM y)
SELECT row_number() OVER (ORDER BY share DESC, btw DESC, a) AS rank, a AS node_id, round(share, 6) AS influence_score, coalesce(nullif(concat_ws(',', CASE WHEN btw >= 0.5 THEN 'high_betweenness' END,
  CASE WHEN deg >= 0.5 THEN 'high_connectivity' END, CASE WHEN clo >= 0.5 THEN 'short_network_distance' END, CASE WHEN pr >= mean THEN 'high_recursive_network_influence' END), ''), 'combined_network_metrics') AS reasons FROM z""")
def key_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the repeat pairs ranked by influence."""
    g = repeated(spark, sf_dir)
    found = roles.key_individuals(metrics(g, views.pair_nodes(g)))
    return found.select("rank", "node_id", F.round("influence_score", 6).alias("influence_score"), F.array_join("reasons", ",").alias("reasons"))


@query()
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeat pairs' bridges with unusual activity; betweenness is taken over its largest value, as none reaches one half here."""
    g = repeated(spark, sf_dir)
    scaled = projection.normalized(stored(centrality.path_centralities(g, views.pair_nodes(g)), "path-metrics"), "betweenness_centrality")
    found = anomaly.convergence(views.interactions(spark, sf_dir), scaled, YEAR, YEAR_BEFORE, WIDE_MINUTES)
    return found.select("entity_id", "target_event_count", F.round("score", 6).alias("score"), "severity")


@query()
def workflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small investigation of the repeat pairs: the status and the size of what each step found."""
    g = repeated(spark, sf_dir)
    nodes = views.pair_nodes(g).select("node_id", F.lit("ENTITY").alias("kind"), F.when(F.col("node_id").startswith("C"), "PERSON").otherwise("ORGANIZATION").alias("type"), F.col("node_id").alias("label"))
    edges = g.select(F.concat_ws("-", "src", "dst").alias("edge_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(None).cast("timestamp").alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"), F.lit(1.0).alias("confidence"))
    events = views.interactions(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string")).withColumn("confidence", F.lit(1.0))
    types = {"target_entity_types": ["PERSON", "ORGANIZATION"], "include_event_interactions": False}
    steps = [workflow.Step("expand", "EXPAND_NETWORK", {"seed_entity_ids": [seed(g)], "depth": 2}), workflow.Step("groups", "COMMUNITY_DETECTION", types), workflow.Step("report", "REPORT", {"title": "Network of one supplier"})]
    links = [workflow.Link("1", "expand", "groups"), workflow.Link("2", "groups", "report")]
    _, results = workflow.execute(workflow.Workflow("W1", steps, links), workflow.Graph(nodes, events, edges))
    size = lambda r: sum(v.count() for v in r.output.values() if isinstance(v, DataFrame))
    return spark.createDataFrame([(r.step, r.type, r.status, size(r)) for r in results], "step string, type string, status string, n_rows long")
