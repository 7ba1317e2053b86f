"""Contract, provenance, store, rules, resolution and review of evidence on small hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inquest.operators import contract, crossdoc, evidence, paths, projection, provenance, resolution, rule_fields, store, validation
from inquest.plans import workflow

FIELDS = "case_id string, document_id string, doc_type string, ord int, pos int, field_name string, field_value string, confidence double"
ITEM = "array<struct<{}:string,{}:string,confidence:double>>"
EXTRACTION = f"document_id string, document_type string, parties {ITEM.format('name', 'role')}, identifiers {ITEM.format('type', 'value')}, dates {ITEM.format('label', 'value')}, amounts {ITEM.format('label', 'value')}, raw_text string, overall_confidence double"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def fields(spark):
    items = [
        ("d1", 1, 0, "party:complainant_1", "Mr. asha rao"), ("d1", 1, 1, "party:accused_1", "Vik Sen"), ("d1", 1, 2, "party:witness_1", "Asha Rao"), ("d1", 1, 3, "bank account", "12 34"), ("d1", 1, 4, "amount:total USD", "$1,000.50"),
        ("d1", 1, 5, "date:occurrence", "05-01-2024"), ("d1", 1, 6, "date:dispatch", "06-01-2024"), ("d1", 1, 7, "date:arrest", "unknown"), ("d1", 1, 8, "rule:gate", "PASSED"), ("d1", 1, 9, "phone", None), ("d1", 1, 10, "district", " "),
        ("d2", 2, 0, "summary:incident_description", "Money left a/c no. 998877 near P.S. airport"), ("d2", 2, 1, "party:complainant_1", "ASHA RAO"),
    ]
    return spark.createDataFrame([("c", d, "fir_report", o, p, n, v, 0.8) for d, o, p, n, v in items], FIELDS)


def test_contract_of_documents_and_case(fields):
    found = contract.entities(fields).cache()
    happened = contract.events(fields, found).cache()
    related = contract.relationships(fields, found, happened).cache()
    assert _rows(found, "id", "type", "normalized_name", "role") == [
        ("ENT-d1-01", "PERSON", "Asha Rao", "complainant"), ("ENT-d1-02", "PERSON", "Vik Sen", "accused"), ("ENT-d1-03", "ACCOUNT", "12 34", "participant"), ("ENT-d1-04", "LOCATION", "", "participant"),
        ("ENT-d2-01", "PERSON", "Asha Rao", "complainant"), ("ENT-d2-02", "ACCOUNT", "998877", "victim_account"), ("ENT-d2-03", "ORGANIZATION", "Airport", "police_jurisdiction"),
    ]
    assert _rows(happened, "id", "type", "timestamp", "currency") == [("EVT-d1-01", "FINANCIAL_FRAUD", "2024-01-05", "USD"), ("EVT-d1-03", "ARREST", "unknown", "USD"), ("EVT-d2-01", "INCIDENT", None, "INR")]
    assert _rows(related.where("document_id = 'd1'"), "id", "source_entity", "target_entity", "relationship_type") == [
        ("REL-d1-01", "ENT-d1-01", "ENT-d1-03", "ACCOUNT_HOLDER"), ("REL-d1-02", "ENT-d1-01", "EVT-d1-01", "VICTIM_OF"), ("REL-d1-03", "ENT-d1-02", "EVT-d1-01", "ACCUSED_IN"), ("REL-d1-04", "ENT-d1-03", "EVT-d1-01", "DEBITED_IN"),
        ("REL-d1-05", "ENT-d1-01", "EVT-d1-03", "VICTIM_OF"), ("REL-d1-06", "ENT-d1-02", "EVT-d1-03", "ACCUSED_IN"),
    ]
    people, told, links = contract.case_contract(found, happened, related)
    assert "ENT-d2-01" not in {r.id for r in people.collect()} and people.count() == 6
    assert _rows(told.where("document_id = 'd2'"), "source_entity") == [("ENT-d1-01",)]
    assert _rows(links.where("document_id = 'd2'"), "source_entity", "target_entity") == [("ENT-d1-01", "ENT-d2-02"), ("ENT-d1-01", "EVT-d2-01")]
    assert _rows(contract.quality_gates(fields), "gate", "outcome") == [("rule:gate", "PASSED")]
    assert contract.entities(fields.where("false")).count() == 0
    of = {r.id: r for r in found.collect()}
    assert of["ENT-d1-01"].attributes == {"raw_field_name": "party:complainant_1"} and tuple(of["ENT-d1-01"].source) == ("d1", "d1", None, 1, None, "Mr. asha rao")
    assert of["ENT-d2-02"].attributes == {"inferred_from": "incident_narrative", "bank_branch": "Airport Branch"} and of["ENT-d2-02"].source.text_span.startswith("a/c no. 998877")
    said = {r.id: (r.attributes, r.source.text_span) for r in happened.collect()}
    assert said == {
        "EVT-d1-01": ({"total_amount": "1000.5", "currency": "USD", "raw_label": "date:occurrence"}, "05-01-2024"), "EVT-d1-03": ({"raw_label": "date:arrest"}, "unknown"),
        "EVT-d2-01": ({"total_amount": None, "currency": "INR"}, "Money left a/c no. 998877 near P.S. airport"),
    }
    why = {r.id: r.evidence for r in related.where("document_id = 'd1'").collect()}
    assert why["REL-d1-01"] == "Bank account registered under complainant name" and why["REL-d1-03"] == "Accused implicated in event Incident Occurrence / Fraudulent Transactions" and why["REL-d1-04"] == "Fraudulent amount debited from account ENT-d1-03"
    located = fields.withColumn("filename", F.lit("f.pdf")).withColumn("file_hash_sha256", F.lit("h")).withColumn("bounding_box", F.struct(*(F.when(F.col("pos") > 0, 2).alias(k) for k in "xywh")))
    boxes = {r.id: (r.source.filename, r.source.file_hash_sha256, r.source.bounding_box and r.source.bounding_box.w) for r in contract.entities(located).collect()}
    assert boxes["ENT-d1-01"] == ("f.pdf", "h", None) and boxes["ENT-d1-02"] == ("f.pdf", "h", 2.0) and boxes["ENT-d2-02"] == ("f.pdf", "h", None)
    spark = fields.sparkSession
    docs = spark.createDataFrame([("c", "d1", "f.pdf", "h", "fir_report", None, ["x", "y"]), ("c", "d2", "g.pdf", "i", "other", 0.5, None)], "case_id string, document_id string, filename string, file_hash_sha256 string, doc_type string, overall_confidence double, flags array<string>")
    assert {r.document_id: (r.overall_confidence, r.validation_flags_count, r.quality_gates) for r in contract.audit_chain(fields, docs).collect()} == {"d1": (0.9, 2, {"rule:gate": "PASSED"}), "d2": (0.5, 0, {})}


def test_provenance(spark, fields):
    items = provenance.field_items(fields)
    assert items.count() == 11 and items.where("label = 'phone'").count() == 0
    refs = lambda *rows: spark.createDataFrame([(o, d, "h", 1, None) for o, d in rows], "object_id string, document_id string, file_hash string, page int, text_span string")
    findings = spark.createDataFrame([("F1", ["N", "E", "E"], None), ("F2", None, ["gone"])], "finding_id string, a array<string>, b array<string>")
    links = provenance.finding_links(findings, "a", "b")
    nodes = spark.createDataFrame([("N",)], "node_id string")
    found = provenance.finding_references(links, refs(("N", "d1"), ("N", "d1")), refs(("N", "d9"), ("E", "d1"), ("E", "d2")), nodes)
    assert _rows(found, "finding_id", "document_id") == [("F1", "d1"), ("F1", "d2")]
    assert _rows(provenance.summary(items, items.limit(0)), "object_type", "n_items") == [("FIELD", 11), ("TOTAL", 11)]


def test_store(spark, tmp_path):
    versions = spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "y", "p"), ("b", 1, "z", None)], "id string, v int, status string, kept string")
    path = str(tmp_path / "t")
    store.append(versions, path)
    store.append(store.updated(versions, spark.createDataFrame([("a", 3, "w")], "id string, v int, status string"), "id", "v"), path)
    assert _rows(store.latest(spark.read.parquet(path), "id", "v").where("id = 'a'"), "v", "status", "kept") == [(3, "w", "p")]
    cleared = store.updated(versions, spark.createDataFrame([("a", 3, None, ["kept"]), ("b", 2, "n", None)], "id string, v int, status string, cleared array<string>"), "id", "v")
    assert _rows(cleared, "id", "v", "status", "kept") == [("a", 3, "y", None), ("b", 2, "n", None)]
    with pytest.raises(store.NotFound):
        store.by_id(versions, "id", "c")
    assert store.by_id(versions, "id", "b").count() == 1
    people = spark.createDataFrame([("1", "PERSON", "asha RAO"), ("2", "PERSON", "No One"), ("3", "ACCOUNT", "asha rao")], "id string, type string, name string")
    assert _rows(store.persons_of(people, spark.createDataFrame([("Asha Rao",)], "person string")).where("person IS NOT NULL"), "id") == [("1",)]


@pytest.fixture(scope="module")
def extractions(spark):
    rows = [
        ("s", "seizure_memo", [("A", "Panch witness", 0.9), ("B", None, 0.9)], [("seal no", "7", 0.9)], None, None, None, 0.95),
        ("f", "fir_report", None, [("FIR No", "1/24", 0.5), ("IPC", "420", 0.9), ("act", "379", 0.9)], [("occurrence", "05-01-2024", 0.9), ("registration", "04-01-2024", 0.9)], None, "", 0.7),
        ("i", "bank_statement", None, None, None, None, None, 0.9),
    ]
    return spark.createDataFrame(rows, EXTRACTION)


def test_rules_and_derived_fields(spark, extractions):
    flags = validation.rule_flags(extractions)
    assert _rows(flags, "document_id", "flag") == [("f", "chronology_violation"), ("f", "missing_police_station"), ("s", "insufficient_panch_witnesses")]
    sums = spark.createDataFrame([("i", False, 2.5, 1.0)], "document_id string, matched boolean, difference double, tax double")
    got = {(r.document_id, r.field_name): r.field_value for r in rule_fields.rule_fields(extractions, flags, sums).collect()}
    assert got["s", "rule:panchnama_statutory_validity"].startswith("DEFICIENT - Only 1 ") and got["s", "rule:sample_seal_condition"].startswith("VERIFIED")
    assert got["f", "rule:penal_sections_detected"] == "420, 379" and got["f", "rule:temporal_integrity_status"].startswith("FLAGGED")
    assert got["i", "rule:arithmetic_reconciliation"].endswith("2.5") and got["i", "rule:computed_tax_reconciliation"] == "Calculated: 1.00" and got["i", "rule:commercial_document_type"] == "Audited Bank Statement"
    assert (got["i", "rule:quality_gate_status"], got["f", "rule:quality_gate_status"]) == ("PASSED", "REVIEW REQUIRED (2 flag(s))")
    found = {r.document_id: (r.escalate, r.reasons) for r in validation.escalations(extractions, sums).collect()}
    assert found["i"] == (True, ["arithmetic_mismatch"]) and found["s"][1] == ["critical_flag"] and found["f"][1] == ["critical_flag", "too_many_flags", "low_confidence"]


def test_resolution_order_keys_and_types(spark):
    rows = [("z", "PERSON", "Asha Rao", {"msisdn": "+91 98765 43210"}), ("a", "PERSON", "Zed Rao", {"msisdn": "098765 43210"}), ("k", "ACCOUNT", "AC-1 2", {}), ("j", "ACCOUNT", "ac12", {})]
    people = spark.createDataFrame([(i, t, n, None, None, a) for i, t, n, a in rows], "id string, type string, name string, normalized_name string, role string, attributes map<string,string>")
    found = {(r.left_id, r.right_id): r for r in resolution.candidates(people).collect()}
    assert set(found) == {("z", "a"), ("k", "j")}  # by name, not by id
    assert found["z", "a"].strong == 1.0 and found["k", "j"].strong == 1.0 and "shared_identifier" in found["k", "j"].reasons
    assert not found["z", "a"].contradicted


def test_graph_lookups(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "a", "c"), ("4", "c", "x")], "edge_id string, source_id string, target_id string")
    assert [_rows(projection.neighbors(edges, "a", d), "node_id") for d in ("out", "in", "both")] == [[("b",), ("c",)], [("b",)], [("b",), ("c",)]]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node_id string")
    shown, kept = projection.without_isolates(nodes, edges)
    assert _rows(shown, "node_id") == [("a",), ("b",), ("c",)] and _rows(kept, "edge_id") == [("1",), ("2",), ("3",)]
    events = spark.createDataFrame([("e", "b", "d"), ("f", "q", None)], "event_id string, source_entity_id string, target_entity_id string")
    assert paths.shortest_path(paths.evidence_links(edges, events), "a", "d") == ["a", "b", "e", "d"]
    assert _rows(projection.touching(events, nodes, ("source_entity_id", "target_entity_id")), "event_id") == [("e",)]


def test_evidence_graph(spark):
    people = spark.createDataFrame([("p1", "PERSON", "A", 0.9), ("p2", "PERSON", "A.", 0.5), ("p3", "PERSON", "B", 1.0)], "id string, type string, name string, confidence double")
    events = spark.createDataFrame([("e1", "T", "t", "p2", "lost")], "id string, type string, title string, source_entity string, target_entity string")
    links = spark.createDataFrame([("r1", "p1", "p3", "K", 1.0), ("r2", "p1", "p2", "K", 1.0), ("r3", "p1", "none", "K", 1.0)], "id string, source_entity string, target_entity string, relationship_type string, confidence double")
    codes = {r.code for r in evidence.contract_issues(people, events, links).collect()}
    assert codes == {"DANGLING_EVENT_TARGET", "DANGLING_TARGET_ENDPOINT"}
    with pytest.raises(evidence.ContractError):
        evidence.adapt(people, events, links, strict=True)
    merged = spark.createDataFrame([("p1", ["p1", "p2"])], "canonical_id string, member_ids array<string>")
    nodes, edges, issues = evidence.build(people, events, links, merged)
    assert _rows(nodes, "node_id", "confidence") == [("e1", 1.0), ("p1", 0.5), ("p3", 1.0)]
    assert _rows(edges, "edge_id") == [("r1",)] and _rows(issues, "code", "object_id") == [("COLLAPSED_SELF_RELATIONSHIP", "r2"), ("DANGLING_RELATIONSHIP", "r3")]


def test_cases(spark):
    parties = spark.createDataFrame([("c", "d1", 1, 0, "Mr Asha Rao", "x"), ("c", "d2", 2, 0, "asha", "y"), ("c", "d2", 2, 1, "Al", "z")], "case_id string, document_id string, ord int, pos int, name string, role string")
    assert _rows(crossdoc.persons(parties), "person", "n_documents", "n_mentions") == [("Asha Rao", 2, 2)]
    items = spark.createDataFrame([("c", "d1", 1, 0, "FIR No", "12/24"), ("c", "d2", 2, 0, "fir", "13/24"), ("c", "d2", 2, 1, "Mobile", "5")], "case_id string, document_id string, ord int, pos int, type string, value string")
    assert _rows(crossdoc.identifiers(items), "category", "value") == [("FIR / Crime No", "12/24"), ("FIR / Crime No", "13/24")]


def test_review_step_and_unknown_type(spark):
    nodes = spark.createDataFrame([("a", "ENTITY", "PERSON", "A"), ("b", "ENTITY", "PERSON", "B")], "node_id string, kind string, type string, label string")
    events = spark.createDataFrame([("e", "a", "b", dt.datetime(2024, 1, 1), 1.0)], "event_id string, source_entity_id string, target_entity_id string, start_at timestamp, confidence double").withColumn("end_at", F.col("start_at"))
    edges = spark.createDataFrame([("r", "a", "b", 1.0)], "edge_id string, source_id string, target_id string, confidence double").withColumns({"start_at": F.lit(None).cast("timestamp"), "end_at": F.lit(None).cast("timestamp")})
    refs = spark.createDataFrame([("a", "d1", "h", 1, None), ("r", "d1", "h", 1, None), ("r", "d2", "h", 1, None)], "object_id string, document_id string, file_hash string, page int, text_span string")
    step = workflow.Step("s", "EVIDENCE_REVIEW", {"entity_ids": ["a"], "relationship_ids": ["r"]})
    status, results = workflow.execute(workflow.Workflow("w", [step]), workflow.Graph(nodes, events, edges, refs))
    assert status == "COMPLETED" and _rows(results[0].output["references"], "object_id", "object_type", "document_id") == [("a", "ENTITY", "d1"), ("r", "RELATIONSHIP", "d2")]
    assert workflow.validate(workflow.Workflow("w", [workflow.Step("s", "NOTHING")])) == [("UNKNOWN_NODE_TYPE", "s")]
