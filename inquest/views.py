"""The shared star-schema tables seen as an evidence graph.

Customers and suppliers are entities; an order's lines are interactions of its
customer with their suppliers at the order date; events are activity of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.storage import table

#: Lines that a task takes to find distinct ones and to count pairs, whatever the size of the table and of Spark's splits.
LINES_IN_TASK = 250_000


def person(column: str):
    return F.concat(F.lit("C"), F.col(column).cast("string"))


def organization(column: str):
    return F.concat(F.lit("S"), F.col(column).cast("string"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity events: each user is the source, there is no target."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("event_type"), at.alias("start_at"), at.alias("end_at"), F.col("user_id").cast("string").alias("source_entity_id"), F.lit(None).cast("string").alias("target_entity_id")
    )


def _tasks(lines: DataFrame) -> int:
    """Tasks that share these lines; the count comes from the footers of the files."""
    return -(-lines.count() // LINES_IN_TASK) or 1


def _order_suppliers(lines: DataFrame) -> DataFrame:
    """Distinct orders and suppliers of lines, dealt by order first: nearly all are distinct, so a split of the file that summed them up before would hold all of its rows."""
    return lines.select("l_orderkey", "l_suppkey").repartition(_tasks(lines), "l_orderkey").distinct()


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order and supplier: the customer meets the supplier on the order date."""
    lines = _order_suppliers(table(spark, sf_dir, "lineitem"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("start_at"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("l_orderkey").alias("event_id"), "start_at", F.col("start_at").alias("end_at"), person("o_custkey").alias("source_entity_id"), organization("l_suppkey").alias("target_entity_id"))


def interaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same interactions as dated edges with an id."""
    return interactions(spark, sf_dir).select(
        F.concat_ws("-", F.col("event_id").cast("string"), "target_entity_id").alias("edge_id"), F.col("source_entity_id").alias("source_id"), F.col("target_entity_id").alias("target_id"), "start_at", "end_at"
    )


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier pairs weighted by the orders that they share."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = _order_suppliers(lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_orderkey")
    counted = met.repartition(_tasks(lines), "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.count_distinct("l_orderkey").cast("double").alias("weight"))
    return counted.select(person("o_custkey").alias("src"), organization("l_suppkey").alias("dst"), "weight")


def repeat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that share at least two orders: the graph of the metrics over all paths, whose cost is nodes times pairs."""
    return order_pairs(spark, sf_dir).where("weight >= 2")


def pair_nodes(pairs: DataFrame) -> DataFrame:
    """The distinct ends of pairs."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
