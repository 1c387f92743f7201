"""Uploads in batch and as a stream, packages inside packages with bounds, masked output, sessions and late rows."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.plans import files, streams
from corvane.sources import masked, packages, uploads
from corvane.streaming import runs
from tests.harness import assert_same, connection


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def nested(depth):
    inner = zipped(a_DOT_xml="<a/>")
    for _ in range(depth):
        inner = zipped(x__embeddings__ole_DOT_bin=inner)
    return inner


def opened(spark, content):
    rows = spark.createDataFrame([("f", content)], "path string, content binary")
    found = packages.parts(rows)
    return {r["part"]: r["xml"] is not None or r["content"] is not None for r in found.collect()}, {r["part"] for r in packages.unopened(found).collect()}


def test_packages_are_told_by_content_and_bounded(spark, monkeypatch):
    parts, missing = opened(spark, nested(2))
    step = "x/embeddings/ole.bin"
    assert parts == {step: True, f"{step}|{step}": True, f"{step}|{step}|a.xml": True} and missing == set()
    parts, missing = opened(spark, nested(packages.MAX_DEPTH + 2))
    assert len(parts) == packages.MAX_DEPTH + 2 and missing == {"|".join([step] * (packages.MAX_DEPTH + 1)) + "|"}
    assert opened(spark, zipped(x__embeddings__plain_DOT_bin=b"PKxx"))[0] == {"x/embeddings/plain.bin": True}
    assert opened(spark, b"PK\x03\x04broken")[1] == {None}
    monkeypatch.setattr(packages, "MAX_UNPACKED", 1000)
    bomb = zipped(a_DOT_xml="<a/>", big_DOT_xml="0" * 5_000_000, b_DOT_xml="<b/>")
    rows = {part: xml is not None for part, xml, _ in packages._opened(bomb, budget=[1000])}
    assert rows == {"a.xml": True, "big.xml": False, "b.xml": True}  # reported, and what follows is read


def test_a_stream_of_uploads_equals_the_batch(spark, small, tmp_path):
    rows = [r for r in files._uploaded(spark, small.replace("0.001", "0.01")).collect() if len(r["content"])]  # Spark lists no empty files
    for r in rows:
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / r["path"].replace("#", "-")).write_bytes(bytes(r["content"]))
    where = f"file://{tmp_path}/in"
    batch = spark.read.format("binaryFile").load(where)
    want = sorted(map(tuple, uploads.judged(batch).collect()))
    got = sorted(map(tuple, uploads.judged_stream(spark, where, per_batch=7).collect()))
    assert got == want and len(want) == len(rows) and len({w[3] for w in want}) > 2
    passed = {r["path"] for r in uploads.admitted(batch).collect()}
    refused = [r["path"] for r in uploads.quarantined(batch).collect()]
    assert passed.isdisjoint(refused) and len(passed) + len(refused) == len(rows) and len(set(refused)) == len(refused)


def test_masked_output_of_any_shape(spark, tmp_path):
    bodies = [(1, '{"filename": "a", "masked_chunks": [{"text": "x"}, {"text": null}, {"other": 1}]}'), (2, "{}"), (3, "not json"), (4, '{"masked_chunks": 5}'), (5, '{"filename": "a",\n "masked_chunks": []}')]
    path = f"file://{tmp_path}/out"
    masked.write_outputs(spark.createDataFrame(bodies, "run_id long, body string"), path)
    known = spark.createDataFrame([(i, 7, "sanitization", "completed") for i in range(1, 7)], "run_id long, created_by long, agent string, status string")
    asked = spark.createDataFrame([(i, 7, i) for i in range(1, 8)] + [(20, 8, 1), (21, 9, 1)], "request long, user_id long, run_id long")
    reviewers = spark.createDataFrame([(9,), (9,)], "user_id long")
    out = {r["request"]: tuple(r)[1:] for r in masked.read_back(asked, known, reviewers, masked.outputs(spark, path)).collect()}
    broken = ("broken file", None, None, None)
    assert out == {
        1: ("read", "a", 3, "x\n\n\n\n"), 2: ("read", None, 0, ""), 3: broken, 4: broken, 5: ("read", "a", 0, ""), 6: ("no file", None, None, None),
        7: ("no such run", None, None, None), 20: ("not allowed", None, None, None), 21: ("read", "a", 3, "x\n\n\n\n"),
    }


@pytest.fixture(scope="module")
def unordered(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{small}/events.parquet").repartition(40, F.col("event_id") % 40).write.parquet(f"{folder}/events.parquet")
    return folder


def test_sessions_of_unordered_files(spark, unordered):
    assert_same(streams.stream_sessions(spark, unordered), connection(unordered), streams.ORACLE["stream_sessions"])


def test_late_rows_are_a_side_output(spark, unordered):
    """Files of mixed times in three batches: what is older than the batches before, less the delay, is late; nothing is lost."""
    rows = runs.on_time_and_late(runs.events_stream(spark, unordered), "10 days", "late")
    late, total = rows.where("late").count(), rows.count()
    events = spark.read.parquet(f"{unordered}/events.parquet")
    assert total == events.count() == rows.select("event_id").distinct().count() and 0 < late < total
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    assert rows.where("late").agg(F.max("ts")).first()[0] < last and runs.on_time_and_late(runs.events_stream(spark, unordered), "400 days", "late").where("late").isEmpty()


def test_annotations_keep_what_stands_above():
    from xml.etree import ElementTree

    from corvane.sources import annotations

    w = 'xmlns:w="urn:w"'
    xml = (
        f'<w:document {w}><w:p><w:ins w:author="A"><w:r><w:t>one</w:t></w:r><w:del w:author="B"><w:r><w:delText>two</w:delText></w:r></w:del></w:ins>'
        '<w:commentRangeStart w:id="1"/><w:r><w:t>three</w:t></w:r><w:commentRangeStart w:id="2"/><w:r><w:t>four</w:t></w:r><w:commentRangeEnd w:id="1"/><w:r><w:t>five</w:t></w:r><w:commentRangeEnd w:id="2"/><w:r><w:t>six</w:t></w:r></w:p></w:document>'
    )
    found = [(kind, author, e.text if key is None else e.attrib[key]) for kind, author, e, key in annotations._walk(ElementTree.fromstring(xml))]
    assert found == [
        ("author", None, "A"), ("inserted", "A", "one"), ("author", None, "B"), ("deleted", "B", "two"),
        ("commented", "1", "three"), ("commented", "1", "four"), ("commented", "2", "four"), ("commented", "2", "five"),
    ]


def test_annotations_of_broken_and_foreign_parts(spark):
    from corvane.sources import annotations

    rows = spark.createDataFrame([("f", "word/comments.xml", "<broken", None), ("f", "word/other.xml", "<a/>", None), ("f", "word/people.xml", None, None), ("f", None, None, None), ("g", "xl/persons/person.xml", '<p><person displayName="X y"/></p>', None)], "path string, part string, xml string, content binary")
    found = annotations.annotations(rows)
    assert [tuple(r)[3:] for r in found.collect()] == [("author", None, "X y")]
    clean = {r["part"]: (r["xml"], r["changed"]) for r in annotations.scrubbed(rows, [("x", "[T]")]).collect()}
    assert clean["word/comments.xml"] == ("<broken", 0) and 'displayName=""' in clean["xl/persons/person.xml"][0]
    assert annotations.annotations(rows.limit(0)).collect() == [] and annotations.residual(found, []).count() == 1
