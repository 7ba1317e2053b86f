"""Roles in the network: communities, bridges and key individuals."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.numbers import numbered
from inquest.operators.components import components
from inquest.operators.numbering import positions, ranks, running_sums
from inquest.operators.projection import both_ways, normalized
from inquest.storage import discard, stored

MOST_SWEEPS = 50
#: Pairs of a component up to which one task takes it whole; larger ones are spread over tasks.
MOST_IN_TASK = 100_000
# Weights of the influence and bridge scores.
INFLUENCE = {"degree_centrality": 0.25, "betweenness_centrality": 0.35, "closeness_centrality": 0.15, "pagerank": 0.25}
BRIDGE = (0.65, 0.35)


def _parts(pairs: DataFrame) -> DataFrame:
    """node_id, component: the linked nodes with the least node of their component."""
    return stored(components(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "node_id"), "parts")


def _in_parts(pairs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of each pair (node_id, neighbor_id, component): those of components that a task can hold, and those of larger ones."""
    ways = stored(both_ways(pairs).join(parts, "node_id"), "ways-in-parts")
    large = stored(ways.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * MOST_IN_TASK).select("component"), "large-parts")
    # Components that a task cannot hold are few: each has more than MOST_IN_TASK pairs.
    return ways.join(large, "component", "left_anti"), ways.join(large, "component", "left_semi")


def _neighbors(rows: pd.DataFrame) -> dict[str, list[str]]:
    return {k: sorted(set(v)) for k, v in rows.groupby("node_id")["neighbor_id"]}


def _propagate(rows: pd.DataFrame) -> pd.DataFrame:
    """Labels spread node by node in id order: the most frequent label of the neighbours, the smallest of equals."""
    near = _neighbors(rows)
    label = {node: node for node in near}
    for _ in range(MOST_SWEEPS):
        moved = False
        for node in sorted(near):
            votes: dict[str, int] = {}
            for other in near[node]:
                votes[label[other]] = votes.get(label[other], 0) + 1
            best = min(votes, key=lambda v: (-votes[v], v))
            moved |= best != label[node]
            label[node] = best
        if not moved:
            break
    return pd.DataFrame({"node_id": list(label), "label": list(label.values())})


def _waves(ways: DataFrame) -> DataFrame:
    """node_id, wave: a node's wave comes after those of all its smaller neighbours, so that within a wave no two nodes are neighbours."""
    down = stored(ways.where("neighbor_id < node_id").select("node_id", "neighbor_id"), "down")
    wave = stored(ways.select("node_id").distinct().withColumn("wave", F.lit(0)), "waves")
    while True:
        later = down.join(wave.withColumnRenamed("node_id", "neighbor_id"), "neighbor_id").groupBy("node_id").agg((F.max("wave") + 1).alias("least"))
        moved = stored(wave.join(later, "node_id", "left").select("node_id", F.greatest("wave", "least").alias("wave"), F.coalesce(F.col("least") > F.col("wave"), F.lit(False)).alias("moved")), "waves", (wave,))
        wave = moved.drop("moved")
        if moved.where("moved").isEmpty():
            discard(down)
            return moved.select("node_id", "wave")


def _sweeps(ways: DataFrame) -> DataFrame:
    """The same labels as `_propagate`, for components of any size: a node votes once its smaller neighbours have.

    The sweep in id order fixes for each pair who votes first, and nothing else. So all nodes of a wave vote at once,
    and each wave is a join of their neighbours' labels and an aggregation. As many waves as the longest way along
    increasing ids: few where ids are spread over the network, many along a chain of increasing ids.
    """
    wave = stored(_waves(ways), "node-waves")
    last = wave.agg(F.max("wave")).first()[0]
    if last is None:
        return ways.select("node_id", F.col("node_id").alias("label"))
    voters = stored(ways.select("node_id", "neighbor_id").join(wave, "node_id"), "voters")
    labels = stored(wave.select("node_id", "wave", F.col("node_id").alias("label"), F.lit(False).alias("moved")), "labels")
    for _ in range(MOST_SWEEPS):
        labels = labels.withColumn("moved", F.lit(False))
        for k in range(last + 1):
            heard = voters.where(F.col("wave") == k).join(labels.select(F.col("node_id").alias("neighbor_id"), "label"), "neighbor_id")
            votes = heard.groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("n"))
            best = votes.groupBy("node_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("best"))
            new = labels.join(best, "node_id", "left").select("node_id", "wave", F.coalesce("best.label", "label").alias("label"), (F.col("moved") | F.coalesce(F.col("best.label") != F.col("label"), F.lit(False))).alias("moved"))
            labels = stored(new, "labels", (labels,))
        if labels.where("moved").isEmpty():
            break
    return labels.select("node_id", "label")


def communities(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """node_id, community_id, member_count by label propagation; isolated nodes are communities of their own.

    Labels never cross components and a settled component stays so: a component of up to MOST_IN_TASK pairs is swept in
    one task, larger ones by waves over all tasks, with the same labels. Ids are COMM_001 and on by least member.
    """
    small, large = _in_parts(pairs, _parts(pairs))
    found = small.groupBy("component").applyInPandas(_propagate, "node_id string, label string")
    if not large.isEmpty():
        found = found.unionByName(_sweeps(large))
    labels = stored(ids.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("label")), "labels")
    groups = labels.groupBy("label").agg(F.min("node_id").alias("least"), F.count(F.lit(1)).alias("member_count"))
    named = positions(groups, "least").withColumn("community_id", numbered("COMM_", F.col("position"), 3))
    return labels.join(named, "label").select("node_id", "community_id", "member_count")


def _cut_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes whose removal parts their component, with the least member of each part: depth-first lowpoints, without recursion."""
    near = _neighbors(rows)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    least: dict[str, str] = {}
    split: dict[str, list[str]] = {}
    root = min(near)
    stack = [(root, "", iter(near[root]))]
    order[root] = low[root] = 0
    least[root] = root
    while stack:
        node, parent, rest = stack[-1]
        for other in rest:
            if other == parent:
                continue
            if other in order:
                low[node] = min(low[node], order[other])
            else:
                order[other] = low[other] = len(order)
                least[other] = other
                stack.append((other, node, iter(near[other])))
                break
        else:
            stack.pop()
            if stack:
                above = stack[-1][0]
                low[above] = min(low[above], low[node])
                least[above] = min(least[above], least[node])
                if low[node] >= order[above]:
                    split.setdefault(above, []).append(least[node])
    parts = {node: below + [root] * (node != root) for node, below in split.items()}  # the part above holds the root, the least of all
    found = [(node, member) for node, members in parts.items() if len(members) > 1 for member in members]
    return pd.DataFrame(found, columns=["node_id", "least"])


def _tree(ways: DataFrame) -> list[DataFrame]:
    """Breadth-first levels below the least node of each component: node_id, parent, component. As many steps as the network is deep."""
    levels = [stored(ways.where("node_id = component").select("node_id", F.lit(None).cast("string").alias("parent"), "component").distinct(), "tree")]
    seen = levels[0].select("node_id")
    while True:
        met = levels[-1].select(F.col("node_id").alias("parent"), "component").join(ways.select(F.col("node_id").alias("parent"), "neighbor_id"), "parent")
        new = met.groupBy(F.col("neighbor_id").alias("node_id")).agg(F.min("parent").alias("parent"), F.first("component").alias("component")).join(seen, "node_id", "left_anti")
        new = stored(new, "tree")
        if new.isEmpty():
            return levels
        levels.append(new)
        seen = seen.unionByName(new.select("node_id"))


def _parts_around(ways: DataFrame) -> DataFrame:
    """The rows of `_cut_nodes` for components of any size.

    In a breadth-first tree each other pair closes a cycle: up from both ends until the ways meet. Tree pairs (named by
    their lower node) on one cycle lie in one block; cycles are climbed level by level, equal pairs of ancestors once,
    and blocks are components of these links. A node in two blocks or more is a cut node, and each of its blocks leads
    to one part: the one with the pair above holds the root, others the nodes below.
    """
    levels = _tree(ways)
    tree = stored(reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(k)) for k, level in enumerate(levels)]), "tree")
    end = lambda side: tree.select(F.col("node_id").alias(side), F.col("parent").alias(f"{side}_up"), F.col("depth").alias(f"{side}_depth"))
    pairs = ways.where("node_id < neighbor_id").select(F.col("node_id").alias("a"), F.col("neighbor_id").alias("b"))
    # Of the two ends, `low` is the deeper one or equally deep: ends of a pair differ by one level at most.
    met = pairs.join(end("a"), "a").join(end("b"), "b").where("NOT coalesce(a_up = b, false) AND NOT coalesce(b_up = a, false)")
    turned = F.when(F.col("a_depth") >= F.col("b_depth"), _ends("a", "b")).otherwise(_ends("b", "a"))
    cycles = stored(met.select(turned.alias("x")).select("x.*"), "cycles")
    slanted = cycles.where("low_depth > high_depth")
    start = cycles.where("low_depth = high_depth").select("low", "high", "high_depth").unionByName(slanted.select(F.col("up").alias("low"), "high", "high_depth"))
    start = stored(start.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b"), F.col("high_depth").alias("depth")).distinct(), "climb")
    links = slanted.select(F.col("low").alias("a"), F.inline(F.array(F.struct(F.col("up").alias("b")), F.struct(F.col("high").alias("b")))))
    climbing = start.limit(0).select("a", "b")
    for k in range(len(levels) - 1, 0, -1):
        here = stored(start.where(F.col("depth") == k).select("a", "b").unionByName(climbing).distinct(), "climb")
        up = lambda side: levels[k].select(F.col("node_id").alias(side), F.col("parent").alias(f"{side}_up"))  # noqa: B023, E731
        parted = here.join(up("a"), "a").join(up("b"), "b").where("a_up <> b_up")
        links = links.unionByName(here).unionByName(parted.select("a", F.col("a_up").alias("b")))
        climbing = parted.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
    blocks = stored(components(links), "blocks").select(F.col("node").alias("_node"), F.col("component").alias("_block"))
    joined = tree.where("parent is not null").join(_least_below(levels), "node_id").join(blocks, F.col("node_id") == F.col("_node"), "left")
    named = stored(joined.select("node_id", "parent", "component", "least", F.coalesce("_block", "node_id").alias("block")), "in-blocks")
    below = named.select(F.col("parent").alias("node_id"), "block", "least")
    above = named.select("node_id", "block", F.col("component").alias("least"))
    parts = stored(below.unionByName(above).groupBy("node_id", "block").agg(F.min("least").alias("least")), "block-parts")
    cut = parts.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")
    return parts.join(cut, "node_id", "left_semi").select("node_id", "least")


def _ends(low: str, high: str) -> Column:
    return F.struct(F.col(low).alias("low"), F.col(f"{low}_up").alias("up"), F.col(f"{low}_depth").alias("low_depth"), F.col(high).alias("high"), F.col(f"{high}_depth").alias("high_depth"))


def _least_below(levels: list[DataFrame]) -> DataFrame:
    """node_id, least: the least node of each subtree, from the leaves up, one aggregation a level."""
    done, under = [], None
    for level in reversed(levels):
        own = level.select("node_id", "parent", F.col("node_id").alias("least"))
        if under is not None:
            own = own.join(under, "node_id", "left").select("node_id", "parent", F.least("least", "below").alias("least"))
        own = stored(own, "least-below")
        done.append(own.select("node_id", "least"))
        under = own.groupBy(F.col("parent").alias("node_id")).agg(F.min("least").alias("below"))
    return reduce(DataFrame.unionByName, done)


def _local_groups(parts: DataFrame, ids: DataFrame, linked: DataFrame) -> DataFrame:
    """Parts around cut nodes (node_id, least) -> node_id, n_parts, neighbor_groups.

    A group is numbered among all parts that the removal of its node leaves in the whole network, by least member: those
    of other components, isolated nodes too, and its own. Components before a member are a running sum over all tasks.
    """
    firsts = ids.select("node_id").distinct().join(linked, "node_id", "left").where("component is null or component = node_id").select(F.col("node_id").alias("least"), F.lit(1).alias("n"))
    known = running_sums(firsts.unionByName(parts.select("least", F.lit(0).alias("n")).distinct()), "n", "least", F.desc("n"), name="before")
    before = stored(known.groupBy("least").agg(F.max("before").alias("before")), "parts-before")
    # A hub may have many parts: they are ranked over all tasks. The node's own component begins before each of its parts, and is not counted.
    ranked = ranks(parts.join(before, "least"), ["node_id"], "least", name="own")
    named = ranked.select("node_id", F.concat(F.lit("LOCAL_"), "node_id", F.lit("_"), numbered("", F.col("before") - 1 + F.col("own"), 3)).alias("group"))
    return named.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_list("group")).alias("neighbor_groups"))


def bridges(pairs: DataFrame, metrics: DataFrame, minimum_ratio: float = 0.5, communities: DataFrame | None = None) -> DataFrame:
    """Nodes that hold parts of the network together: rank, node_id, n_parts, neighbor_groups, bridge_score, supporting ids.

    A node counts if its removal puts its neighbours into two or more parts; the share of neighbours across parts is 1 for
    all of these. The groups are the `communities` (node_id, community_id) of the neighbours where these are two or more,
    else the parts. metrics: node_id (every node of the network) and betweenness_centrality. Supporting ids come from
    pairs that have them. Ranks go by score, betweenness and id. Components of up to MOST_IN_TASK pairs are taken whole
    by a task, larger ones level by level over all tasks.
    """
    parts = _parts(pairs)
    small, large = _in_parts(pairs, parts)
    found = small.groupBy("component").applyInPandas(_cut_nodes, "node_id string, least string")
    if not large.isEmpty():
        found = found.unionByName(_parts_around(large))
    if minimum_ratio > 1:
        found = found.where("false")  # the share of neighbours across parts is 1 for every cut node
    grouped = _local_groups(stored(found, "parts-around"), metrics, parts)
    if communities is not None:
        near = both_ways(pairs).join(communities.select(F.col("node_id").alias("neighbor_id"), "community_id"), "neighbor_id").select("node_id", "community_id").distinct()
        shown = near.groupBy("node_id").agg(F.array_sort(F.collect_list("community_id")).alias("_shown"))
        grouped = grouped.join(shown, "node_id", "left").withColumn("neighbor_groups", F.when(F.size("_shown") > 1, F.col("_shown")).otherwise(F.col("neighbor_groups"))).drop("_shown")
    score = F.least(F.lit(1.0), BRIDGE[0] * F.col("betweenness_centrality") + BRIDGE[1])
    scored = grouped.join(metrics.select("node_id", "betweenness_centrality"), "node_id").withColumn("bridge_score", score)
    held = [c for c in ("relationship_ids", "event_ids") if c in pairs.columns]
    if held:
        support = both_ways(pairs, *held).groupBy("node_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"supporting_{c}") for c in held))
        scored = scored.join(support, "node_id")
    return positions(scored, F.desc("bridge_score"), F.desc("betweenness_centrality"), "node_id", name="rank")


def key_individuals(metrics: DataFrame, top_k: int | None = None) -> DataFrame:
    """Nodes ranked by influence with the reasons: rank, node_id, influence_score, reasons. metrics: node_id and the four centralities, of which twelve digits count: nodes in the same place in the network are equal."""
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    metrics = metrics.withColumns({c: F.round(c, 12) for c in INFLUENCE})
    influence = sum(w * F.col(c) for c, w in INFLUENCE.items())
    scored = normalized(stored(metrics.withColumn("influence_score", influence), "influence"), "influence_score")
    mean = scored.agg(F.avg("pagerank")).first()[0] or 0.0
    reason = lambda test, name: F.when(test, name)
    reasons = F.array_compact(
        F.array(
            reason(F.col("betweenness_centrality") >= 0.5, "high_betweenness"),
            reason(F.col("degree_centrality") >= 0.5, "high_connectivity"),
            reason(F.col("closeness_centrality") >= 0.5, "short_network_distance"),
            reason(F.col("pagerank") >= mean, "high_recursive_network_influence"),
        )
    )
    order = [F.desc("influence_score"), F.desc("betweenness_centrality"), F.asc("node_id")]
    ranked = positions(scored.orderBy(*order).limit(top_k) if top_k else scored, *order, name="rank")
    return ranked.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("combined_network_metrics"))))
