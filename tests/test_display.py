"""The network of a case as it is shown, small reports, records and catalogs."""

import json

from inquest.operators import display, evidence
from inquest.sources import files


def tables(spark):
    documents = spark.createDataFrame([("c", "a.pdf", 0.9), ("c", "b.pdf", 0.8), ("c", "b.pdf", 0.8), ("lone", "x.pdf", 0.5)], "case_id string, filename string, overall_confidence double")
    people = spark.createDataFrame([("c", 1, "Asha Rao", ["complainant", "SHO"], ["a.pdf", "b.pdf"]), ("c", 2, "Om Das", ["accused"], ["gone.pdf"])], "case_id string, place int, person string, roles array<string>, documents array<string>")
    entities = spark.createDataFrame(
        [("c", "E1", "PERSON", "asha rao.", "asha rao", "complainant", 0.7, "a.pdf"), ("c", "E2", "ACCOUNT", "AC 1", None, None, 0.6, "b.pdf"), ("c", "E3", "OTHER", "hash", None, None, 0.6, "b.pdf"), ("c", "E4", "PERSON", "Nobody Else", "", "witness", 0.4, None)],
        "case_id string, id string, type string, name string, normalized_name string, role string, confidence double, filename string",
    )
    events = spark.createDataFrame([("c", "V1", "SEIZURE", "Recovery", "E2", "E3", "b.pdf"), ("c", "V2", "ARREST", "Arrest", None, None, "a.pdf"), ("c", "V3", "INCIDENT", "Told", None, None, "a.pdf")], "case_id string, id string, type string, title string, source_entity string, target_entity string, filename string")
    relationships = spark.createDataFrame(
        [("c", 1, "R1", "E1", "E2", "ACCOUNT_HOLDER", 0.98, None), ("c", 2, "R2", "E1", "E2", "ACCOUNT_HOLDER", 0.5, "again"), ("c", 3, "R3", "E1", "V3", "VICTIM_OF", 0.95, "told"), ("c", 4, "R4", "E1", "E1", "SELF", 1.0, None), ("c", 5, "R5", "E2", "E3", "TO_HIDDEN", 1.0, None)],
        "case_id string, ord int, id string, source_entity string, target_entity string, relationship_type string, confidence double, evidence string",
    )
    return documents, people, entities, events, relationships


def test_network(spark):
    nodes, edges = display.network(*tables(spark))
    got = {(r.source, r.target, r.relationship_type): (r.id, r.label, r.confidence, r.evidence, r.contextual) for r in edges.collect()}
    assert got == {
        ("person:asha rao", "E2", "ACCOUNT_HOLDER"): ("R1", "Account Holder", 0.98, display.OF_RELATIONSHIP, False),
        ("person:asha rao", "V3", "VICTIM_OF"): ("R3", "Victim Of", 0.95, "told", False),
        ("E2", "V1", "SEIZURE_SOURCE"): ("V1:source", "Seizure Source", 1.0, display.OF_EVENT, True),
        ("V1", "document:b.pdf", "OBSERVED_IN"): ("V1:evidence:b.pdf", "Observed In", 1.0, "Observed in b.pdf.", True),
        ("V3", "document:a.pdf", "OBSERVED_IN"): ("V3:evidence:a.pdf", "Observed In", 1.0, "Observed in a.pdf.", True),
        ("E2", "document:b.pdf", "OBSERVED_IN"): ("E2:evidence:b.pdf", "Observed In", 0.6, "Observed in b.pdf.", True),
        ("person:asha rao", "document:a.pdf", "OBSERVED_IN"): ("person:asha rao:evidence:a.pdf", "Observed In", 1.0, "Observed in a.pdf.", True),
        ("person:asha rao", "document:b.pdf", "OBSERVED_IN"): ("person:asha rao:evidence:b.pdf", "Observed In", 1.0, "Observed in b.pdf.", True),
    }
    shown = {r.id: (r.kind, r.type, r.role, r.look, r.degree) for r in nodes.where("case_id = 'c'").collect()}
    assert shown == {
        "document:a.pdf": ("document", "document", None, "document", 2), "document:b.pdf": ("document", "document", None, "document", 3), "person:asha rao": ("entity", "person", "complainant", "officer", 4), "E2": ("entity", "account", "observed", "account", 3), "V1": ("event", "event", None, "event", 2), "V3": ("event", "event", None, "event", 2),
    }
    assert [r.id for r in nodes.where("case_id = 'lone'").collect()] == ["document:x.pdf"]
    every, _ = display.network(*tables(spark), isolates=True)
    assert {tuple(r) for r in display.counts(every).collect()} == {("c", 8, 6, 2, 4, 2), ("lone", 1, 0, 1, 0, 0)}
    none, no_edges = display.network(*(t.limit(0) for t in tables(spark)))
    assert none.count() == 0 and no_edges.count() == 0


def test_reports(spark):
    people = spark.createDataFrame([("c", f"P{k}", k // 2) for k in range(12)], "case_id string, person string, n_documents int")
    assert [r.person for r in sorted(display.dossier_persons(people).collect(), key=lambda r: r.rank)] == ["P10", "P11", "P8", "P9", "P6", "P7", "P4", "P5"]
    flags = spark.createDataFrame([("c", "d1", ["a", "b"]), ("c", "d2", None), ("c", "d3", ["x"]), ("e", "d4", [])], "case_id string, document_id string, flags array<string>")
    assert {tuple(r) for r in display.unresolved(flags).collect()} == {("c", 3), ("e", 0)}
    nodes = spark.createDataFrame([(f"n{k:03d}", "ENTITY" if k % 2 else "EVENT", "PERSON", None, 1.0) for k in range(300)], "node_id string, kind string, type string, label string, confidence double")
    assert [r.node_id for r in display.plan_entities(nodes).collect()] == [f"n{k:03d}" for k in range(1, 160, 2)]
    edges = spark.createDataFrame([("r", "n000", "n001")], "edge_id string, source_id string, target_id string")
    records = {r.id: (r.kind, json.loads(r.record)) for r in evidence.to_records(nodes.limit(3), edges).collect()}
    assert len(records) == 4 and records["r"] == ("edge", {"edge_id": "r", "source_id": "n000", "target_id": "n001"}) and records["n001"][1]["label"] is None


def test_dataset_catalog_and_rejected_files(spark, tmp_path):
    for name, size in (("fir/1.txt", 3), ("fir/2.txt", 4), ("fir/.hidden", 1), ("memo/big.bin", 50)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    datasets = spark.createDataFrame([("f", "fir", "Reports"), ("m", "memo", "Memos"), ("n", "none", "None")], "key string, dir string, name string")
    assert {r.key: r["count"] for r in files.dataset_catalog(spark, str(tmp_path), datasets).collect()} == {"f": 2, "m": 1, "n": 0}
    assert [tuple(r) for r in files.rejected(spark, str(tmp_path), 10).collect()] == [("big.bin", 50, "FILE_TOO_LARGE")]


def test_steps_of_the_network_go_when_the_next_ones_are_there(spark):
    """F3 display_network: all steps lay on the disk until the end, the edges with their texts too."""
    from pathlib import Path

    from inquest import catalog
    from inquest.storage import shared_dir
    from tests.conftest import SMALL

    steps = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = steps()
    edges = catalog.queries()["display_network"](spark, SMALL)
    left = {name.rsplit("-", 1)[0] for name in steps() - before}
    assert "edges-placed" in left and not left & {"fields", "contract-entities", "contract-events", "contract-relationships", "display-entities", "display-edges", "edges-from", "name-pieces", "case-names"}
    assert edges.count() > 1000


def test_a_stored_step_leaves_no_shuffle_files(spark, monkeypatch):
    """the setting that deletes them was read as unset, and so never turned on."""
    from inquest import storage

    seen, plain = [], spark.conf.get(storage.CLEANUP)
    conf = type(spark.conf)
    put = conf.set
    monkeypatch.setattr(conf, "set", lambda self, key, value: seen.append((key, value)) or put(self, key, value))
    assert storage.stored(spark.range(10).groupBy("id").count(), "counts").count() == 10
    assert seen == [(storage.CLEANUP, "true"), (storage.CLEANUP, plain)] and spark.conf.get(storage.CLEANUP) == plain
