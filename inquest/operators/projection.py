"""The undirected entity graph: pairs of entities with their weight and support, and what follows from it directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquest.functions.numbers import ordered_pair

#: An edge or event adds at least this much to the weight of its pair.
LEAST_WEIGHT = 0.05


def eligible(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Entity nodes of these types."""
    return nodes.where((F.col("kind") == "ENTITY") & F.col("type").isin(types))


def pairs(edges: DataFrame, events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per undirected pair: weight, and the sorted distinct ids of the edges and events that support it.

    edges: edge_id, source_id, target_id, confidence; events: event_id, source_entity_id, target_entity_id, confidence
    (0 or null counts as 1 for an event). ids: node_id of eligible entities, both ends must be among them.
    Edges and events go through one aggregation, partial before the shuffle.
    """
    worth = lambda c: F.greatest(F.lit(LEAST_WEIGHT), c)
    of_edges = edges.select(*ordered_pair("source_id", "target_id"), worth(F.col("confidence")).alias("weight"), F.col("edge_id").alias("relationship_id"), F.lit(None).cast("string").alias("event_id"))
    sure = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    of_events = events.select(*ordered_pair("source_entity_id", "target_entity_id"), worth(sure).alias("weight"), F.lit(None).cast("string").alias("relationship_id"), F.col("event_id").cast("string"))
    both = of_edges.unionByName(of_events).where("src <> dst")
    if ids is not None:
        for end in ("src", "dst"):
            both = both.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    sorted_ids = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), sorted_ids("relationship_id"), sorted_ids("event_id"))


def both_ways(pairs: DataFrame, *keep: str) -> DataFrame:
    """Each pair as two rows of node_id, neighbor_id: one pass over the pairs."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("neighbor_id")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("neighbor_id")))
    return pairs.select(*keep, F.inline(ends))


def degrees(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Per eligible node, isolated ones too: degree, weighted_degree, degree_centrality (over all eligible nodes but one)."""
    counted = both_ways(pairs, "weight").groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    total = ids.agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).first()[0]
    all_nodes = ids.select("node_id").distinct().join(counted, "node_id", "left")
    degree = F.coalesce("degree", F.lit(0))
    return all_nodes.select("node_id", degree.alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"), (degree / total).alias("degree_centrality"))


def isolates(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Eligible nodes without a pair."""
    linked = both_ways(pairs).select("node_id").distinct()  # pairs lie in small files for their number: whoever builds a table of one side must not hold all their rows
    return ids.join(linked, "node_id", "left_anti")


def scoped(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends among `ids`; no ids mean no scope: all pairs."""
    if ids.isEmpty():
        return pairs
    for end in ("src", "dst"):
        pairs = pairs.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return pairs


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_entities, n_events, n_edges. nodes: node_id, kind."""
    of_nodes = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "ENTITY").alias("n_entities"), F.count_if(F.col("kind") == "EVENT").alias("n_events"))
    return of_nodes.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row with one row


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Distinct neighbours (node_id) of a node along edges (source_id, target_id): "out", "in" or "both"."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    ways = {"out": [("source_id", "target_id")], "in": [("target_id", "source_id")]}
    ends = ways.get(direction, ways["out"] + ways["in"])
    met = F.array_compact(F.array(*(F.when(F.col(near) == node, F.col(far)) for near, far in ends)))
    touching = F.greatest(*(F.col(near) == node for near, _ in ends)) if len(ends) > 1 else F.col(ends[0][0]) == node
    return edges.where(touching).select(F.explode(met).alias("node_id")).distinct()


def touching(rows: DataFrame, ids: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Rows with at least one of two ends among `ids` (node_id)."""
    marked = rows
    for i, end in enumerate(ends):
        marked = marked.join(ids.select(F.col("node_id").alias(end)).distinct().withColumn(f"_in{i}", F.lit(True)), end, "left")
    return marked.where("_in0 OR _in1").select(*rows.columns)


def without_isolates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id) with an edge between shown nodes, and those edges (source_id, target_id)."""
    shown = edges
    for end in ("source_id", "target_id"):
        shown = shown.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return nodes.join(shown.select(F.explode(F.array("source_id", "target_id")).alias("node_id")), "node_id", "left_semi"), shown.select(*edges.columns)


def supported(found: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Findings about pairs (src, dst) with an id for each edge and event between the two: finding columns, support, object_id. A row per id: a hot pair is no list."""
    of_edges = edges.select(*ordered_pair("source_id", "target_id"), F.lit("RELATIONSHIP").alias("support"), F.col("edge_id").cast("string").alias("object_id"))
    of_events = events.select(*ordered_pair("source_entity_id", "target_entity_id"), F.lit("EVENT").alias("support"), F.col("event_id").cast("string").alias("object_id"))
    return found.join(of_edges.unionByName(of_events), ["src", "dst"])


def adjacency(pairs: DataFrame) -> DataFrame:
    """Per node the sorted array of its neighbours."""
    return both_ways(pairs).groupBy("node_id").agg(F.array_sort(F.collect_set("neighbor_id")).alias("neighbors"))


def strongest(pairs: DataFrame, top: int) -> DataFrame:
    """The `top` pairs by weight, ties by ids."""
    return pairs.orderBy(F.desc("weight"), "src", "dst").limit(top)


def normalized(values: DataFrame, column: str) -> DataFrame:
    """`values` with `column` over its largest value; 0 where that is not positive."""
    most = values.agg(F.max(column)).first()[0]
    share = F.col(column) / most if most and most > 0 else F.lit(0.0)
    return values.withColumn(column, share)


def first_of(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
