"""Recorded model outputs: shapes of sections, defaults, issues, mined phrases and tall fields."""

import json
import random
import re

import pytest

from inquest.functions import mining
from inquest.operators import extraction

FENCED = """Here is the extracted document data:
```json
{
  "document_type": "invoice",
  "parties": [{"name": "Acme Corp", "role": "vendor", "confidence": 0.95}],
  "dates": [{"label": "invoice_date", "value": "2026-04-10", "confidence": 0.98, "bounding_box": {"x": 100, "y": 200, "w": 300, "h": 50}}],
  "amounts": [{"label": "total", "value": 1540.50, "currency": "USD", "confidence": 0.99}],
  "identifiers": [{"type": "invoice_number", "value": "INV-2026-001", "confidence": 0.97}],
  "raw_text": "Invoice from Acme Corp", "notes_on_legibility": "Clear scan", "overall_confidence": 0.96
}
```
Let me know if you need more analysis."""
COMMAS = """{"document_type": "receipt", "parties": ["Store 123",], "dates": [],
 "amounts": [{"label": "total", "value": "$45.99", "currency": "USD", "confidence": 0.9,},],
 "identifiers": [], "raw_text": "Total 45.99", "notes_on_legibility": "Slight crumple", "overall_confidence": 0.88,}"""
SHAPES = {
    "dates": {"seized": {"value": "2024-01-02", "confidence": 0.5}, "arrest": "2024-01-03", "none": None, "bare": {}},
    "identifiers": {"z": 7, "a": {"value": True, "confidence": "0.25"}, "m": None},
    "amounts": {"total": "Rs 1,200.50", "tax": 3, "odd": [1]}, "parties": {"buyer": "Zoe", "agent": None}, "document_type": " Police REPORT ", "raw_text": "a text of some length",
}
LISTS = {
    "document_type": "Letter of Intent", "parties": ["A", {"value": "B"}, {"party": "C", "role": ""}, {"role": "D"}, 5, None], "dates": ["1.1.2020", {"type": "due", "value": None}, 7, {"value": 12.5}],
    "amounts": [5, "x", {"type": "fee", "value": "-3", "currency": None}, {"label": "", "value": None}, True, None, [2]], "identifiers": ["I", {"key": "K", "value": "V"}, {"label": "L", "type": "", "value": {"a": 1}}], "overall_confidence": "0.5", "raw_text": '{"inner": 1}',
}
BROKEN = {
    "parties": [{"name": "Fine"}, {"name": "Out", "confidence": 1.5}], "dates": [{"value": "1", "confidence": None}], "identifiers": [{"value": "i", "bounding_box": [1, 2]}, {"value": "j", "bounding_box": {"x": "7"}}],
    "amounts": [{"value": 1, "confidence": "high"}], "document_type": 5,
}


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "fenced": FENCED, "commas": COMMAS, "shapes": json.dumps(SHAPES), "lists": json.dumps(LISTS), "broken": json.dumps(BROKEN), "cut": json.dumps(LISTS)[:150],
        "section": '{"dates": "yesterday", "parties": ["X"]}', "void": '{"amounts": null}', "confident": '{"overall_confidence": 2, "parties": ["X"]}', "none": None, "empty": "", "array": '["parties"]',
        "prose": "Complainant Name: Ram Singh; Accused: ram singh; FIR No: 12/2024 on 01-02-2024, Rs. 1,500.00 taken. SHA-256: " + "ab" * 32, "twice": '{"parties": ["A"], "parties": ["B"]}',
    }
    df = spark.createDataFrame([(k, t, 1, "clash") for k, t in texts.items()], "document_id string, text string, extra int, dates string").repartition(3)
    return extraction.extracted(df)


@pytest.fixture(scope="module")
def rows(found):
    return {r.document_id: r for r in found.collect()}


def plain(items):
    return [tuple(x)[:-1] for x in items]


def test_fences_and_commas(rows):
    r = rows["fenced"]
    assert (r.document_type, plain(r.parties), plain(r.amounts), r.overall_confidence, r.issues) == ("invoice", [("Acme Corp", "vendor", 0.95)], [("total", 1540.5, "USD", 0.99)], 0.96, [])
    assert tuple(r.dates[0].bounding_box) == (100, 200, 300, 50) and r.notes_on_legibility == "Clear scan" and r.extra == 1
    r = rows["commas"]
    assert (r.document_type, plain(r.parties), plain(r.amounts), r.raw_text) == ("receipt", [("Store 123", "party", 0.9)], [("total", 45.99, "USD", 0.9)], "Total 45.99")
    assert plain(r.dates) == [("total", "$45.99", 0.9)]  # an empty section is mined, and this piece reads like a date's


def test_shapes_of_sections(rows):
    r = rows["shapes"]
    assert r.document_type == "fir_report" and r.issues == []
    assert plain(r.dates) == [("seized", "2024-01-02", 0.5), ("arrest", "2024-01-03", 0.9), ("bare", "", 0.9)]
    assert plain(r.identifiers) == [("z", "7", 0.9), ("a", "True", 0.25)]
    assert plain(r.amounts) == [("total", 1200.5, "INR", 0.9), ("tax", 3.0, "INR", 0.9), ("odd", 0.0, "INR", 0.9)] and plain(r.parties) == [("Zoe", "buyer", 0.9), ("None", "agent", 0.9)]
    r = rows["lists"]
    assert (r.document_type, r.overall_confidence, r.raw_text) == ("letter of intent", 0.5, "{\\")  # what is mined from JSON ends at the first quote
    assert plain(r.parties) == [("A", "party", 0.9), ("B", "party", 0.9), ("C", "party", 0.9), ("Unknown Party", "D", 0.9)]
    assert plain(r.dates) == [("date", "1.1.2020", 0.9), ("due", "None", 0.9), ("date", "12.5", 0.9)]
    assert plain(r.amounts) == [("amount", 5.0, "INR", 0.9), ("amount", 0.0, "INR", 0.9), ("fee", -3.0, None, 0.9), ("amount", 0.0, "INR", 0.9), ("amount", 1.0, "INR", 0.9)]
    assert plain(r.identifiers) == [("identifier", "I", 0.9), ("K", "V", 0.9), ("L", '{"a":1}', 0.9)]


def test_issues(rows):
    r = rows["broken"]
    assert plain(r.parties) == [("Fine", "party", 0.9)] and plain(r.identifiers) == [("identifier", "j", 0.9)] and r.identifiers[0].bounding_box.x == 7 and r.document_type == "contract"  # by the letters "mou" of its text
    assert {tuple(i) for i in r.issues} == {("parties", 2, "BAD_CONFIDENCE"), ("dates", 1, "BAD_CONFIDENCE"), ("amounts", 1, "BAD_CONFIDENCE"), ("identifiers", 1, "BAD_BOUNDING_BOX")}
    assert [tuple(rows[k].issues[0]) for k in ("section", "void", "confident", "none", "array")] == [("dates", None, "WRONG_TYPE"), ("amounts", None, "WRONG_TYPE"), ("overall_confidence", None, "WRONG_TYPE"), ("document", None, "NOT_JSON"), ("document", None, "NOT_JSON")]
    assert rows["section"].notes_on_legibility == extraction.MINED_NOTE and rows["section"].parties == []
    assert plain(rows["cut"].parties)[:3] == plain(rows["lists"].parties)[:3] and plain(rows["twice"].parties) == [("B", "party", 0.9)]
    assert (rows["empty"].raw_text, rows["none"].parties, rows["none"].overall_confidence) == ("", [], 0.8)


def test_phrases_fill_empty_sections(rows):
    r = rows["prose"]
    assert plain(r.parties) == [("Ram Singh", "complainant", 0.85)] and ("FIR Number", "12/2024", 0.85) in plain(r.identifiers) and ("SHA-256 Hash", "ab" * 32, 0.85) in plain(r.identifiers)
    assert plain(r.dates) == [("Date_1", "01-02-2024", 0.85)] and plain(r.amounts) == [("Property Value / Stated Amount", 1500.0, "INR", 0.85)]
    assert r.document_type == "fir_report" and r.raw_text.startswith("Complainant")


def test_fields(found):
    rows = {}
    for r in extraction.fields(found, "document_id").orderBy("pos").collect():
        rows.setdefault(r.document_id, []).append((r.field_name, r.field_value, r.confidence))
    assert rows["fenced"] == [
        ("party:vendor_1", "Acme Corp", 0.95), ("date:invoice_date", "2026-04-10", 0.98), ("amount:total (USD)", "1540.50", 0.99), ("id:invoice_number", "INV-2026-001", 0.97),
        ("summary:incident_description", "Invoice from Acme Corp", 0.96), ("notes:legibility_assessment", "Clear scan", 1.0),
    ]
    assert ("amount:fee", "-3.00", 0.9) in rows["lists"] and ("party:D_4", "Unknown Party", 0.9) in rows["lists"]
    assert {(r.document_id, r.code) for r in extraction.issues(found, "document_id").collect()} >= {("void", "WRONG_TYPE"), ("none", "NOT_JSON"), ("broken", "BAD_CONFIDENCE")}


def test_empty_table(spark):
    assert extraction.extracted(spark.createDataFrame([], "document_id string, text string")).count() == 0


# One case for each phrase: text, section, label or role, value
CASES = [
    ("Informant: Asha Rao;", "parties", "complainant", "Asha Rao"), ("I beg to state that I, Mohan Lal residing at", "parties", "complainant", "Mohan Lal"), ("Suspect name - B. Khan, x", "parties", "accused", "B. Khan, x"),
    ("Panch no. 2 : Gita Devi;", "parties", "panch_witness", "Gita Devi"), ("Person arrested: Om Puri;", "parties", "arrestee", "Om Puri"), ("Arresting Officer: Insp Das;", "parties", "arresting_officer", "Insp Das"),
    ("Intimated person: Sita;", "parties", "intimated_person", "Sita"), ("Medical officer- Dr. Sen;", "parties", "examining_doctor", "Dr. Sen"), ("Hospital: City Care;", "parties", "hospital", "City Care"),
    ("Deceased: Ravi;", "parties", "victim", "Ravi"), ("SHO: Meena;", "parties", "investigating_officer", "Meena"), ("Seller: Acme & Co;", "parties", "vendor", "Acme & Co"), ("Bill to: Zed 9;", "parties", "buyer", "Zed 9"),
    ("FIR # 77/21", "identifiers", "FIR Number", "77/21"), ("Thana: Kotwali;", "identifiers", "Police Station", "Kotwali"), ("A/c no. 123456 789;", "identifiers", "Bank Account Number", "123456 789"), ("Dist: Agra;", "identifiers", "District", "Agra"),
    ("u/s 302 IPC;", "identifiers", "Act & Section", "302 IPC"), ("FSL ref no: F-1/2", "identifiers", "FSL Reference No", "F-1/2"), ("MLC no. M/9", "identifiers", "Medico-Legal Record No", "M/9"), ("hash: " + "0f" * 32, "identifiers", "SHA-256 Hash", "0f" * 32),
    ("IMEI: 35-99", "identifiers", "Serial / IMEI Number", "35-99"), ("Grounds of arrest: flight risk;", "identifiers", "Grounds of Arrest", "flight risk"), ("Seal mark: AB intact;", "identifiers", "Seal Status", "AB intact"),
    ("G.D. entry: 12-A", "identifiers", "GD Entry No", "12-A"), ("Invoice #: X-1", "identifiers", "Invoice Number", "X-1"), ('{"name": "N N", "role": "clerk"', "parties", "clerk", "N N"), ('{"type": "pan", "value": "P1"', "identifiers", "pan", "P1"),
    ('{"label": "on", "value": "2001"', "dates", "on", "2001"), ("on 2020/1/2.", "dates", "Date_1", "2020/1/2"), ("$ 7", "amounts", "USD", 7.0),
]


@pytest.mark.parametrize("text, section, label, value", CASES)
def test_each_phrase(text, section, label, value):
    assert any(label in item and value in item for item in mining.mine(text)[section]), mining.mine(text)


def test_one_pass_finds_what_each_phrase_finds_alone():
    rng, words = random.Random(5), [w for t, *_ in CASES for w in t.split()] + ["io", "that", "I", ":", "-", "no", "name", "sec", "section", "p.s.", "İ", "ſho", "K", "12-03-2020", "rs.5", "\n"]
    alone = [("party", i, r, p) for i, (r, p) in enumerate((r, p) for r, several in mining.PARTIES.items() for p in several)]
    alone = [(x[0], x[2], x[3]) for x in alone] + [("identifier", label, p) for label, p in mining.IDENTIFIERS.items()]
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", ": "]) for _ in range(rng.randint(1, 25)))
        got = {(p[0], p[2], g) for p, all_ in mining._pieces(text).items() if p[2] for g in all_}
        assert got == {(s, label, m.groups()) for s, label, p in alone for m in re.finditer(p, text, re.I)}
