"""Path metrics, cut nodes and walks against plain definitions on small random graphs."""

import random
from collections import deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inquest.operators import centrality, communities, numbering, paths, projection


def _near(pairs, nodes):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def _reach(near, source, without=None):
    """Distance and number of shortest ways from a node."""
    far, ways, todo = {source: 0}, {source: 1}, deque([source])
    while todo:
        x = todo.popleft()
        for y in near[x] - {without}:
            if y not in far:
                far[y], ways[y] = far[x] + 1, 0
                todo.append(y)
            if far[y] == far[x] + 1:
                ways[y] += ways[x]
    return far, ways


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    nodes = [f"N{k:02d}" for k in range(30)]
    pairs = sorted({tuple(sorted(rng.sample(nodes[:26], 2))) for _ in range(34)})
    frame = spark.createDataFrame(pairs, "src string, dst string")
    return nodes, pairs, frame, spark.createDataFrame([(n,) for n in nodes], "node_id string")


@pytest.mark.parametrize("most, live", [(centrality.MOST_BROADCAST, 0), (0, 30 * 16)])
def test_path_centralities(graph, monkeypatch, most, live):
    monkeypatch.setattr(centrality, "MOST_BROADCAST", most)
    monkeypatch.setattr(centrality, "MOST_LIVE", live)
    nodes, pairs, frame, ids = graph
    near, n = _near(pairs, nodes), len(nodes)
    far = {s: _reach(near, s) for s in nodes}
    between, close = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        d, ways = far[s]
        close[s] = (len(d) - 1) ** 2 / sum(d.values()) / (n - 1) if len(d) > 1 else 0.0
        for t in d:
            for v in d:
                if len({s, t, v}) == 3 and t in far[v][0] and d[v] + far[v][0][t] == d[t]:
                    between[v] += ways[v] * far[v][1][t] / ways[t] / ((n - 1) * (n - 2))
    got = {r.node_id: r for r in centrality.path_centralities(frame, ids).collect()}
    assert set(got) == set(nodes)
    assert all(got[v].betweenness_centrality == pytest.approx(between[v]) and got[v].closeness_centrality == pytest.approx(close[v]) for v in nodes)


def _components(near):
    return sorted({min(_reach(near, n)[0]): sorted(_reach(near, n)[0]) for n in near}.values())


def _random(rng, size, n_pairs):
    nodes = [f"N{k:02d}" for k in range(size)]
    rng.shuffle(nodes)
    return sorted(nodes), sorted({tuple(sorted(rng.sample(nodes[: size - 3], 2))) for _ in range(n_pairs)})


@pytest.mark.parametrize("most, seed", [(communities.MOST_IN_TASK, 1), (0, 2)])
def test_cut_nodes(spark, monkeypatch, most, seed):
    monkeypatch.setattr(communities, "MOST_IN_TASK", most)
    nodes, pairs = _random(random.Random(seed), 26, (24, 30, 20)[seed - 1])
    near, want = _near(pairs, nodes), {}
    for v in nodes:
        rest = {n: near[n] - {v} for n in nodes if n != v}
        number = {n: i for i, part in enumerate(_components(rest), 1) for n in part}
        groups = sorted({f"LOCAL_{v}_{number[n]:03d}" for n in near[v]})
        if len(groups) > 1:
            want[v] = groups
    assert want
    between = {n: random.Random(n).randint(0, 3) / 10 for n in nodes}
    got = communities.bridges(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(list(between.items()), "node_id string, betweenness_centrality double")).collect()
    assert {r.node_id: r.neighbor_groups for r in got} == want and all(r.n_parts == len(want[r.node_id]) for r in got)
    order = sorted(want, key=lambda v: (-min(1.0, 0.65 * between[v] + 0.35), -between[v], v))
    assert [r.node_id for r in sorted(got, key=lambda r: r.rank)] == order


def test_bridges_name_the_communities_of_neighbours(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    metrics = spark.createDataFrame([(n, 0.0) for n in "abcd"], "node_id string, betweenness_centrality double")
    named = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Y")], "node_id string, community_id string")
    got = {r.node_id: r.neighbor_groups for r in communities.bridges(pairs, metrics, communities=named).collect()}
    assert got == {"b": ["X", "Y"], "c": ["X", "Y"]}
    assert communities.bridges(pairs.limit(0), metrics).count() == 0


@pytest.mark.parametrize("most, seed", [(communities.MOST_IN_TASK, 5), (0, 6)])
def test_communities_follow_the_plain_sweep(spark, monkeypatch, most, seed):
    monkeypatch.setattr(communities, "MOST_IN_TASK", most)
    nodes, pairs = _random(random.Random(seed), 24, 40)
    near = _near(pairs, nodes)
    label = {n: n for n in nodes}
    for _ in range(communities.MOST_SWEEPS):
        before = dict(label)
        for n in nodes:
            if near[n]:
                votes = [label[m] for m in near[n]]
                label[n] = min(votes, key=lambda v: (-votes.count(v), v))
        if label == before:
            break
    groups = {}
    for n in nodes:
        groups.setdefault(label[n], []).append(n)
    want = {n: (f"COMM_{i:03d}", len(g)) for i, g in enumerate(sorted(groups.values()), 1) for n in g}
    got = communities.communities(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node_id string"))
    assert {r.node_id: (r.community_id, r.member_count) for r in got.collect()} == want


def test_numbers_in_a_global_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.randint(0, 50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [r.k for r in sorted(numbering.positions(df, "v", "k").collect(), key=lambda r: r.position)] == [r[2] for r in order]
    sums, total = {}, 0
    for r in order:
        total += r[1]
        sums[r[2]] = total
    assert {r.k: r.running for r in numbering.running_sums(df, "v", "v", "k").collect()} == sums
    ranked = numbering.ranks(df, ["g"], F.desc("v"), "k").collect()
    for g in ("a", "b", "hot", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [(r.k, r.rank) for r in sorted((r for r in ranked if r.g == g), key=lambda r: r.rank)] == [(r[2], i) for i, r in enumerate(mine, 1)]
    assert numbering.positions(df.limit(0), "v").count() == 0


def test_shortest_paths(graph):
    nodes, pairs, frame, ids = graph
    near = _near(pairs, nodes)
    for s, t in list(combinations(nodes, 2))[::150]:
        found = paths.shortest_path(frame, s, t)
        d = _reach(near, s)[0].get(t)
        assert (len(found) - 1 == d and all(b in near[a] for a, b in zip(found, found[1:]))) if d is not None else found == []


def test_long_ways_are_found(spark):
    pairs = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(67)], "src string, dst string")
    assert len(paths.shortest_path(pairs, "000", "067")) == 68


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_sources_are_searched_together(monkeypatch, dense):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    ends = np.array(pairs + [(b, a) for a, b in pairs])
    ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
    start, to, sources = np.searchsorted(ends[:, 0], np.arange(41)), ends[:, 1], np.arange(40)
    monkeypatch.setattr(centrality, "DENSE", dense)
    one, single = np.zeros(40), []
    for s in sources:
        single += centrality._from_sources(start, to, sources[s : s + 1], 40, one)
    calls, plain = [], centrality._gathered
    monkeypatch.setattr(centrality, "CHUNK", 7)
    monkeypatch.setattr(centrality, "_gathered", lambda *a: calls.append(1) or plain(*a))
    together = np.zeros(40)
    assert centrality._from_sources(start, to, sources, 40, together) == pytest.approx(single)
    assert together == pytest.approx(one) and len(calls) < 40


def test_pagerank_reads_a_hub_as_several_lists(spark, monkeypatch):
    monkeypatch.setattr(centrality, "MOST_LISTED", 4)
    monkeypatch.setattr(centrality, "WAYS_IN_TASK", 10)
    rng, nodes = random.Random(8), [f"N{k:02d}" for k in range(24)]
    pairs = sorted({tuple(sorted(rng.sample(nodes[1:20], 2))) for _ in range(20)} | {("N00", n) for n in nodes[1:20]})
    near, read = _near(pairs, nodes), []
    lists = centrality._lists
    monkeypatch.setattr(centrality, "_lists", lambda *a: read.append(lists(*a)) or read[0])
    rank = dict.fromkeys(nodes, 1 / 24)
    for _ in range(7):
        lone = sum(rank[n] for n in nodes if not near[n])
        rank = {n: 0.15 / 24 + 0.85 * (sum(rank[m] / len(near[m]) for m in near[n]) + lone / 24) for n in nodes}
    frame, ids = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node_id string")
    got = {r.node_id: r.pagerank for r in centrality.pagerank(frame, ids, rounds=7, tolerance=0).collect()}
    assert got == {n: pytest.approx(rank[n], rel=1e-12) for n in nodes}
    rows = read[0].collect()
    assert sum(len(r.to) for r in rows) == 2 * len(pairs) and max(len(r.to) for r in rows) < 19 and len(rows) > 20


def test_isolates_hold_nodes_and_not_pairs(graph):
    nodes, pairs, frame, ids = graph
    found = projection.isolates(frame, ids)
    assert {r.node_id for r in found.collect()} == set(nodes) - {n for p in pairs for n in p}
    # the table that the join builds has a row for each linked node
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()


def test_components_of_a_large_graph_are_searched_in_tasks(spark, monkeypatch):
    """betweenness_network: a graph too large for the tasks as a whole goes to them by components; only a component that is too large is searched by joins."""
    rng, pairs = random.Random(6), []
    for k in range(5):
        names = [f"N{k}{i:02d}" for i in range(14)]
        pairs += sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(20)})
    hub = [("H00", f"H{i:02d}") for i in range(1, 30)]
    nodes = sorted({n for p in pairs + hub for n in p} | {"lone"})
    frame, ids = spark.createDataFrame(pairs + hub, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node_id string")
    metrics = lambda: {r.node_id: (pytest.approx(r.betweenness_centrality), pytest.approx(r.closeness_centrality)) for r in centrality.path_centralities(frame, ids).collect()}
    whole, joined, plain = metrics(), [], centrality._by_joins
    assert set(whole) == set(nodes)
    monkeypatch.setattr(centrality, "MOST_BROADCAST", 25)
    monkeypatch.setattr(centrality, "_by_joins", lambda pairs, *a: joined.append(pairs.count()) or plain(pairs, *a))
    for block in (1, centrality.BLOCK):
        monkeypatch.setattr(centrality, "BLOCK", block)
        assert {r.node_id: (r.betweenness_centrality, r.closeness_centrality) for r in centrality.path_centralities(frame, ids).collect()} == whole
    assert joined == [29, 29]
