"""The workflow's steps on small graphs."""

import datetime as dt

from inquest.plans import workflow

AT = dt.datetime(2024, 1, 3)


def test_all_detectors_are_in_the_anomaly_step(spark):
    nodes = spark.createDataFrame([(i, "ENTITY", "PERSON", f"Name {i}") for i in "ABCDE"] + [("O", "ENTITY", "ORGANIZATION", "Firm")], "node_id string, kind string, type string, label string")
    event = lambda i, a, b, t: (f"e{i}", a, b, t, t, 1.0)
    before = AT - dt.timedelta(hours=12)
    # A is between B, C and D; in the target window it meets them all, and E, who had no event
    events = [event(k, "A", x, before + dt.timedelta(hours=k)) for k, x in enumerate("BCD")]
    events += [event(10 + k, "A", x, AT + dt.timedelta(minutes=k)) for k, x in enumerate("BCDBCDBCD")]
    events += [event(30, "B", "E", AT + dt.timedelta(hours=2)), event(31, "O", "B", AT + dt.timedelta(hours=3))]
    frame = spark.createDataFrame(events, "event_id string, source_entity_id string, target_entity_id string, start_at timestamp, end_at timestamp, confidence double")
    edges = spark.createDataFrame([], "edge_id string, source_id string, target_id string, start_at timestamp, end_at timestamp, confidence double")
    config = {"target_start": "2024-01-03T00:00:00Z", "target_end": "2024-01-03T23:00:00Z"}
    _, results = workflow.execute(workflow.Workflow("W", [workflow.Step("find", "ANOMALY_DETECTION", config)]), workflow.Graph(nodes, frame, edges))
    assert results[0].status == "COMPLETED", results[0].issue
    rows = results[0].output["findings"].collect()
    of = lambda kind: [(r.entity_id, r.source_entity_id, r.target_entity_id, r.event_count, r.title) for r in rows if r.anomaly_type == kind]
    assert {r.anomaly_type for r in rows} == {"ACTIVITY_SPIKE", "NOVEL_RELATIONSHIP", "INTERACTION_BURST", "CROSS_COMMUNITY_ACTIVITY", "STRUCTURAL_ACTIVITY_CONVERGENCE"}
    # O is no person and had no event before: it has no component
    assert of("CROSS_COMMUNITY_ACTIVITY") == [(None, "B", "E", 1, "New cross-community interaction")]
    # A lies on 5 of the 6 pairs of others, B on E's 3
    role = "Network-bridge role coincides with unusual activity: Name "
    assert of("STRUCTURAL_ACTIVITY_CONVERGENCE") == [("A", None, None, 9, role + "A"), ("B", None, None, 5, role + "B")]
    held = {}
    for r in results[0].output["support"].collect():
        held.setdefault(r.finding_id, set()).add((r.object_type, r.object_id))
    by = {(r.anomaly_type, r.entity_id or r.source_entity_id, r.target_entity_id): r for r in rows}
    assert held[by["CROSS_COMMUNITY_ACTIVITY", "B", "E"].finding_id] == {("EVENT", "e30")}
    spike = by["ACTIVITY_SPIKE", "A", None]
    assert held[spike.finding_id] == {("EVENT", f"e{10 + k}") for k in range(9)} and spike.signals["target_peak_events"] == 9
    assert spike.explanation.startswith("Activity reached 9 event(s) in one 60-minute bucket, versus a baseline mean of 0.")
    assert by["CROSS_COMMUNITY_ACTIVITY", "B", "E"].explanation.endswith("between baseline components BASE_COMM_001 and BASE_COMM_002.")


def test_execution_ids(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("r",)], "edge_id string")
    plan = workflow.Workflow("W", [workflow.Step("s", "REPORT", {"title": "é"})])
    first = workflow.execution_id(plan, workflow.Graph(nodes, None, edges), "case")
    assert first == workflow.execution_id(plan, workflow.Graph(nodes.orderBy(nodes.node_id.desc()).unionByName(nodes), None, edges), "case")
    others = [workflow.execution_id(plan, workflow.Graph(n, None, e), c) for n, e, c in ((nodes, edges, "other"), (nodes.limit(1), edges, "case"), (nodes, edges.limit(0), "case"))]
    assert len({first, *others}) == 4 and first.startswith("EXEC-") and first[5:] == first[5:].lower() and len(first) == 21
