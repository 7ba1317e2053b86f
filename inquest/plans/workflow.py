"""Declarative investigations: a small graph of allow-listed steps over the evidence graph's frames.

The description is data on the driver; each step builds lazy DataFrames from the
operators, and only what a report shows is computed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.operators import anomaly, centrality, communities, findings, paths, projection, temporal
from inquest.operators.provenance import REFERENCE
from inquest.storage import stored

TYPES = {"target_entity_types", "include_event_interactions"}
#: Settings that each kind of step may have, and those that it must have.
ALLOWED: dict[str, set[str]] = {
    "TIME_FILTER": {"start", "end"},
    "EXPAND_NETWORK": {"seed_entity_ids", "depth"},
    "GRAPH_ANALYTICS": TYPES,
    "KEY_INDIVIDUALS": TYPES | {"top_k"},
    "COMMUNITY_DETECTION": TYPES,
    "BRIDGE_ANALYSIS": TYPES | {"minimum_cross_community_ratio"},
    "ANOMALY_DETECTION": {"target_start", "target_end", "baseline_start", "baseline_end", "target_entity_types", "max_findings"},
    "SHORTEST_PATH": {"source_id", "target_id"},
    "EVIDENCE_REVIEW": {"entity_ids", "event_ids", "relationship_ids", "finding_ids"},
    "REPORT": {"title", "include_node_outputs", "notes"},
}
REQUIRED = {"TIME_FILTER": ("start", "end"), "EXPAND_NETWORK": ("depth",), "SHORTEST_PATH": ("source_id", "target_id"), "ANOMALY_DETECTION": ("target_start", "target_end")}
SCOPED = {"GRAPH_ANALYTICS", "KEY_INDIVIDUALS", "COMMUNITY_DETECTION", "BRIDGE_ANALYSIS"}


@dataclass
class Step:
    id: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass
class Link:
    id: str
    source: str
    target: str
    source_port: str = "output"
    target_port: str = "input"
    enabled: bool = True


@dataclass
class Workflow:
    workflow_id: str
    steps: list[Step]
    links: list[Link] = field(default_factory=list)
    version: str = "1.0"
    stop_on_failure: bool = True


@dataclass
class Graph:
    """The evidence graph: nodes (node_id, kind, type, label), events and edges as the temporal operators take them, with confidence."""

    nodes: DataFrame
    events: DataFrame
    edges: DataFrame
    references: DataFrame | None = None


@dataclass
class Result:
    step: str
    type: str
    status: str
    output: dict[str, Any] = field(default_factory=dict)
    issue: str | None = None


class StepError(ValueError):
    """A step that cannot run as configured."""


def _span(config: dict, prefix: str = "") -> tuple[dt.datetime, dt.datetime]:
    """The window of a step in UTC; both ends need an offset."""
    ends = [dt.datetime.fromisoformat(str(config[f"{prefix}{k}"]).replace("Z", "+00:00")) for k in ("start", "end")]
    if any(t.tzinfo is None for t in ends):
        raise StepError("a time window needs offsets")
    low, high = (t.astimezone(dt.timezone.utc).replace(tzinfo=None) for t in ends)
    if low > high:
        raise StepError("a time window starts before it ends")
    return low, high


def _order(w: Workflow) -> list[str]:
    """Steps so that each follows those that it reads; among free ones by id. Steps in a cycle are left out."""
    ids = {s.id for s in w.steps}
    links = [k for k in w.links if k.enabled and {k.source, k.target} <= ids]
    waits = {i: sum(k.target == i for k in links) for i in ids}
    queue = sorted(i for i, n in waits.items() if not n)
    for i in queue:  # grows while it is read
        for target in sorted(k.target for k in links if k.source == i):
            waits[target] -= 1
            if not waits[target]:
                queue.append(target)
    return queue


def validate(w: Workflow) -> list[tuple[str, str]]:
    """Problems as (code, id of the step or link)."""
    found: list[tuple[str, str]] = []
    seen: set[str] = set()
    for s in w.steps:
        c = s.config
        if s.id in seen:
            found.append(("DUPLICATE_NODE_ID", s.id))
        seen.add(s.id)
        if s.type not in ALLOWED:
            found.append(("UNKNOWN_NODE_TYPE", s.id))
        elif set(c) - ALLOWED[s.type]:
            found.append(("UNKNOWN_NODE_CONFIG", s.id))
        found += [("MISSING_NODE_CONFIG", s.id) for k in REQUIRED.get(s.type, ()) if k not in c]
        if "depth" in c and (not isinstance(c["depth"], int) or not 1 <= c["depth"] <= 10):
            found.append(("INVALID_DEPTH", s.id))
        if "top_k" in c and (not isinstance(c["top_k"], int) or c["top_k"] < 1):
            found.append(("INVALID_TOP_K", s.id))
        if ("baseline_start" in c) != ("baseline_end" in c):
            found.append(("PARTIAL_BASELINE_WINDOW", s.id))
        for prefix in ("", "target_", "baseline_"):
            if {f"{prefix}start", f"{prefix}end"} <= set(c):
                try:
                    _span(c, prefix)
                except ValueError:
                    found.append(("INVALID_TIME_WINDOW", s.id))
    by_id = {s.id: s for s in w.steps}
    links: set[str] = set()
    for k in w.links:
        if k.id in links:
            found.append(("DUPLICATE_EDGE_ID", k.id))
        links.add(k.id)
        if k.source not in by_id:
            found.append(("MISSING_SOURCE_NODE", k.id))
        elif k.target not in by_id:
            found.append(("MISSING_TARGET_NODE", k.id))
        else:
            if k.source == k.target:
                found.append(("SELF_LOOP", k.id))
            if k.enabled and by_id[k.target].inputs and k.target_port not in by_id[k.target].inputs:
                found.append(("UNKNOWN_TARGET_PORT", k.target))
            if k.enabled and by_id[k.source].outputs and k.source_port not in by_id[k.source].outputs:
                found.append(("UNKNOWN_SOURCE_PORT", k.source))
    if len(_order(w)) != len(by_id):
        found.append(("WORKFLOW_CYCLE", w.workflow_id))
    return found


def execution_id(w: Workflow, graph: Graph, case_id: str | None = None, contract_version: str = "1.0.0") -> str:
    """A stable id of the workflow over a case's graph, whatever the order of its rows: ids are hashed where they lie.

    Each id's SHA-256 is cut into four numbers, and these are summed up; the sums, the number of ids, the workflow, the
    case and the version of the contract make the id, 16 lower-case hexadecimal digits.
    """

    def mark(rows: DataFrame, key: str) -> list[str]:
        digest = F.sha2(F.col(key).cast("string"), 256)
        piece = lambda k: F.conv(F.substring(digest, 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")
        return [str(x) for x in rows.select(digest.alias("d"), *(piece(k).alias(f"p{k}") for k in range(4))).distinct().agg(F.count(F.lit(1)), *(F.sum(f"p{k}") for k in range(4))).first()]

    known = {"case_id": case_id, "contract_version": contract_version, "node_ids": mark(graph.nodes, "node_id"), "edge_ids": mark(graph.edges, "edge_id")}
    text = json.dumps({"workflow": asdict(w), "graph": known}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return "EXEC-" + hashlib.sha256(text.encode()).hexdigest()[:16]


def _scope(graph: Graph, near: list[Result]) -> Graph:
    """The graph inside the last scope (by step id) among direct inputs; an empty scope is none."""
    for r in reversed(near):
        if "node_ids" in r.output:
            ids = r.output["node_ids"]
            if ids.isEmpty():
                return graph
            nodes = graph.nodes.join(ids, "node_id", "left_semi")
            events = graph.events.join(ids.select(F.col("node_id").alias("event_id")), "event_id", "left_semi")
            edges = graph.edges
            for end in ("source_id", "target_id"):
                edges = edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
            return Graph(nodes, events, edges, graph.references)
    return graph


def _network(graph: Graph, c: dict) -> tuple[DataFrame, DataFrame]:
    """Pairs and eligible ids under a step's settings."""
    ids = stored(projection.eligible(graph.nodes, list(c.get("target_entity_types", ["PERSON"]))).select("node_id"), "eligible")
    events = graph.events if c.get("include_event_interactions", True) else graph.events.where("false")
    return stored(projection.pairs(graph.edges, events, ids), "network"), ids


def _metrics(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return stored(projection.degrees(pairs, ids).join(centrality.path_centralities(pairs, ids), "node_id").join(centrality.pagerank(pairs, ids), "node_id"), "metrics")


def _time_filter(graph: Graph, c: dict, near: list[Result]) -> dict:
    low, high = (F.lit(t).cast("timestamp") for t in _span(c))
    events = temporal.in_window(graph.events, low, high)
    return {"node_ids": stored(temporal.snapshot_nodes(graph.events, graph.edges, low, high), "scope"), "event_ids": events.select("event_id"), "edge_ids": temporal.snapshot_edges(graph.events, graph.edges, low, high)}


def _expand(graph: Graph, c: dict, near: list[Result]) -> dict:
    given = list(c.get("seed_entity_ids", []))
    seeds = graph.nodes.where(F.col("node_id").isin(given)).select("node_id") if given else None
    for r in [] if given else near:
        if "node_ids" in r.output:
            seeds = r.output["node_ids"] if seeds is None else seeds.unionByName(r.output["node_ids"])
    if seeds is None or seeds.isEmpty():
        raise StepError("no seeds to expand from")
    links = graph.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    reached = paths.hops(links, seeds, c["depth"])
    return {"node_ids": reached.select("node_id"), "hops": reached}


def _analytics(graph: Graph, c: dict, near: list[Result]) -> dict:
    pairs, ids = _network(graph, c)
    metrics = _metrics(pairs, ids)
    return {"metrics": metrics, "communities": communities.communities(pairs, ids), "key_individuals": communities.key_individuals(metrics), "bridges": communities.bridges(pairs, metrics)}


def _anomalies(graph: Graph, c: dict, near: list[Result]) -> dict:
    """All five detectors over the events with a person at one end, ranked, with what supports each finding. Spikes are those of persons; a step's own types do not narrow it."""
    target = _span(c, "target_")
    baseline = _span(c, "baseline_") if "baseline_start" in c else None
    pairs, ids = _network(graph, {})
    events = stored(projection.touching(graph.events, ids, ("source_entity_id", "target_entity_id")), "eligible-events")
    people = graph.nodes.join(ids, "node_id", "left_semi").select("node_id", "label")
    found = findings.report(people, events, target, baseline, metrics=centrality.path_centralities(pairs, ids), most=c.get("max_findings", anomaly.MOST_FINDINGS))
    return {"findings": found, "support": findings.support(found, events, graph.edges, target)}


def _path(graph: Graph, c: dict, near: list[Result]) -> dict:
    pairs, ids = _network(graph, c)
    known = {r.node_id for r in ids.where(F.col("node_id").isin(c["source_id"], c["target_id"])).collect()}
    if known != {c["source_id"], c["target_id"]}:
        raise StepError("both ends of a path must be eligible entities")
    path = paths.shortest_path(pairs, c["source_id"], c["target_id"])
    return {"path": path, "hops": max(0, len(path) - 1)}


def _review(graph: Graph, c: dict, near: list[Result]) -> dict:
    """The nodes and relationships that the step names or, where it names none of a kind, that its inputs found; their findings, and the references of all.

    Source references come from `graph.references` (object_id and the columns of a reference), one row each.
    """
    def wanted(column: str, *settings: tuple[str, str]) -> DataFrame | None:
        every = None
        for setting, output in settings:
            given = [str(x) for x in c.get(setting, [])]
            frames = [graph.nodes.sparkSession.createDataFrame([(x,) for x in given], f"{column} string")] if given else [r.output[output].select(F.col(r.output[output].columns[0]).cast("string").alias(column)) for r in near if output in r.output]
            for rows in frames:
                every = rows if every is None else every.unionByName(rows)
        return every

    ids, links = wanted("node_id", ("entity_ids", "node_ids"), ("event_ids", "event_ids")), wanted("edge_id", ("relationship_ids", "edge_ids"))
    nodes = graph.nodes.join(ids, "node_id", "left_semi").dropDuplicates(["node_id"]) if ids is not None else graph.nodes.where("false")
    edges = graph.edges.join(links, "edge_id", "left_semi").dropDuplicates(["edge_id"]) if links is not None else graph.edges.where("false")
    out = {"evidence": nodes, "relationships": edges}
    chosen = [str(x) for x in c.get("finding_ids", [])]
    found = [r.output["findings"] for r in near if "findings" in r.output]
    if found:
        every = reduce(lambda a, b: a.unionByName(b), found)
        out["findings"] = every.where(F.col("finding_id").isin(chosen)) if chosen else every
    if graph.references is not None:
        seen = nodes.select(F.col("node_id").alias("object_id"), F.col("kind").alias("object_type"), F.lit(0).alias("_turn")).unionByName(edges.select(F.col("edge_id").alias("object_id"), F.lit("RELATIONSHIP").alias("object_type"), F.lit(1).alias("_turn")))
        held = graph.references.select("object_id", *REFERENCE).join(seen, "object_id")
        first = held.groupBy(*REFERENCE).agg(F.min(F.struct("_turn", "object_id", "object_type")).alias("_first"))
        out["references"] = first.select("_first.object_id", "_first.object_type", *REFERENCE)
    return out


def _report(graph: Graph, c: dict, near: list[Result]) -> dict:
    chosen = c.get("include_node_outputs")
    kept = [r for r in near if not isinstance(chosen, list) or r.step in chosen]
    return {"title": c.get("title", "Investigation report"), "notes": c.get("notes", ""), "sections": {r.step: r.output for r in kept}}


RUN: dict[str, Callable[[Graph, dict, list[Result]], dict]] = {
    "TIME_FILTER": _time_filter,
    "EXPAND_NETWORK": _expand,
    "GRAPH_ANALYTICS": _analytics,
    "KEY_INDIVIDUALS": lambda g, c, n: {"key_individuals": communities.key_individuals(_metrics(*_network(g, c)), c.get("top_k", 10))},
    "COMMUNITY_DETECTION": lambda g, c, n: {"communities": communities.communities(*_network(g, c))},
    "BRIDGE_ANALYSIS": lambda g, c, n: {"bridges": communities.bridges((p := _network(g, c))[0], _metrics(*p), float(c.get("minimum_cross_community_ratio", 0.5)))},
    "ANOMALY_DETECTION": _anomalies,
    "SHORTEST_PATH": _path,
    "EVIDENCE_REVIEW": _review,
    "REPORT": _report,
}


def execute(w: Workflow, graph: Graph) -> tuple[str, list[Result]]:
    """Runs a workflow: its status and the result of each step in order.

    Disabled steps are skipped. After a failure the rest is skipped, or goes on if the workflow says so.
    """
    if validate(w):
        return "VALIDATION_FAILED", []
    by_id = {s.id: s for s in w.steps}
    done: dict[str, Result] = {}
    halted = False
    for i in _order(w):
        s = by_id[i]
        near = [done[k] for k in sorted({k.source for k in w.links if k.enabled and k.target == i})]
        if halted or not s.enabled:
            done[i] = Result(i, s.type, "SKIPPED_AFTER_FAILURE" if halted else "SKIPPED_DISABLED")
            continue
        try:
            inside = _scope(graph, near) if s.type in SCOPED else graph
            done[i] = Result(i, s.type, "COMPLETED", RUN[s.type](inside, s.config, near))
        except (StepError, ValueError) as e:
            done[i] = Result(i, s.type, "FAILED", issue=f"NODE_EXECUTION_FAILED: {e}")
            halted = w.stop_on_failure
    return "FAILED" if any(r.status == "FAILED" for r in done.values()) else "COMPLETED", list(done.values())


def markdown(results: list[Result], rows: int = 8) -> str:
    """A report of the first rows of every frame that the last step holds."""
    last = results[-1].output if results else {}
    lines = [f"# {last.get('title', 'Investigation report')}", ""]
    for step, output in last.get("sections", {}).items():
        lines += [f"## {step}", ""]
        for name, value in output.items():
            lines.append(f"- {name}: {value}" if not isinstance(value, DataFrame) else f"- {name}:")
            if isinstance(value, DataFrame):
                lines += [f"  - {r.asDict()}" for r in value.limit(rows).collect()]
    return "\n".join(lines + ["", "Findings are investigative leads, not conclusions about guilt."])
