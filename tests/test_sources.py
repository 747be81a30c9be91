"""Sources and sinks over files: logs, indexes, dead letters, migrations, streams and their sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from brindle.operators import relational
from brindle.sources import tables
from brindle.streaming import streams

EVENT = StructType([StructField("event_id", LongType()), StructField("ts", StringType())])
NOTE = StructType([StructField("title", StringType()), StructField("tags", ArrayType(StringType())), StructField("text", StringType())])


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return path


def test_logs(spark, tmp_path):
    good, bad = '{"event_id": 1, "ts": "2024-01-01"}', '{"event_id": '
    ok = _write(str(tmp_path / "ok/a.json"), [good, "", good.replace("1,", "2,")])
    mixed = _write(str(tmp_path / "mixed/a.json"), [good, bad, good.replace("1,", "3,").replace("01-01", "01-02")])
    assert tables.write_ahead_log(spark, ok, EVENT).count() == 2
    with pytest.raises(Exception):
        tables.write_ahead_log(spark, mixed, EVENT).collect()
    assert [r["event_id"] for r in tables.event_log(spark, mixed, EVENT, 5).collect()] == [3, 1]
    assert tables.write_ahead_log(spark, _write(str(tmp_path / "no/a.json"), []), EVENT).count() == 0


def test_note_index_and_markdown(spark, tmp_path):
    path = _write(str(tmp_path / "notes/index.json"), [json.dumps([{"title": "a", "tags": ["x", "y"], "text": "t"}, {"title": None, "tags": None, "text": None}])])
    notes = tables.note_index(spark, path, NOTE)
    assert notes.count() == 2
    assert [r["value"] for r in tables.note_markdown(notes).collect()] == ["## a\ntags: x, y\n\nt\n", "## \ntags: \n\n\n"]


def test_traces(spark):
    rows = spark.createDataFrame([(1, [(("m1", None),)]), (2, [(("m2", "m1"),)]), (3, [(("m3", None),)]), (4, [])], "trace_id int, steps array<struct<output:struct<memory_id:string,target_memory_id:string>>>")
    assert {r["trace_id"] for r in tables.traces_of(rows, "m1").collect()} == {1, 2}


def test_dead_letters_and_migration(spark):
    failed = spark.createDataFrame([(1, "x" * 900)], "id int, error string")
    row = tables.dead_letters(failed, "ingest").first()
    assert (row["fields"], row["source"], len(row["error"])) == ('{"id":1}', "ingest", 500)
    old, new = spark.createDataFrame([("a", 1)], "kind string, id int"), spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 3)], "kind string, id int")
    rows, counts = tables.migrate(old, new, ["kind", "id"])
    assert rows.count() == 3 and counts.first().asDict() == {"incoming": 5, "inserted": 3, "present": 2}
    by_kind = {r["kind"]: (r["incoming"], r["inserted"], r["failed"]) for r in tables.migration_counts(new, rows, "kind", F.col("id") >= 3).collect()}
    assert by_kind == {"a": (3, 1, 0), "b": (1, 1, 0), None: (1, 1, 1)}


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "feedback")
    for i in range(2):
        tables.append_feedback(spark.createDataFrame([(i, "good")], "id int, verdict string"), path)
    assert [r["id"] for r in tables.feedback(spark, path, "id int, verdict string", 5).collect()] == [1, 0]


def test_vector_index(spark):
    index = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    more = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "id string, embedding array<double>")
    added = tables.with_vectors(index, more)
    assert {r["id"]: r["embedding"] for r in added.collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    assert {r["id"] for r in tables.without_vectors(added, spark.createDataFrame([("a",)], "id string")).collect()} == {"b", "c"}


def test_seeds(spark):
    notes = tables.seed_notes(spark, 100)
    assert notes.count() == 100 and notes.where("related_id IS NOT NULL").count() == 10 and notes.where("enrichment_status = 'provisional'").count() == 5
    plan = tables.load_plan(spark, 100, 4, 7)
    assert plan.count() == 400 and {r["profile"]: r["count"] for r in plan.groupBy("profile").count().collect()} == {"ordinary": 280, "active": 80, "burst": 32, "malicious": 8}


def test_streams_of_several_tasks_to_a_table(spark, tmp_path):
    paths = {}
    for name in ("ingest", "query"):
        paths[name] = os.path.dirname(_write(str(tmp_path / name / "a.json"), [json.dumps({"id": i, "ts": f"2024-01-{10 + i} 00:00:00"}) for i in range(3)]))
    stream = streams.task_streams(spark, paths, "id int, ts timestamp")
    out = str(tmp_path / "out")
    streams.append_to(stream, out, str(tmp_path / "state"), keep_days=1).awaitTermination(120)
    assert {(r["task_type"], r["id"]) for r in spark.read.parquet(out).collect()} == {(t, i) for t in paths for i in (1, 2)}


def test_stream_dead_letters(spark, tmp_path):
    folder = os.path.dirname(_write(str(tmp_path / "in/a.json"), ['{"id": 1}', '{"id": null}', '{"id": -4}']))
    stream = spark.readStream.schema("id int").json(folder)
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    streams.with_dead_letters(stream, F.col("id") > 0, good, dead, str(tmp_path / "state"), "ingest", F.lit("no id")).awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(good).collect()] == [1]
    assert {(r["fields"], r["source"], r["error"]) for r in spark.read.parquet(dead).collect()} == {("{}", "ingest", "no id"), ('{"id":-4}', "ingest", "no id")}


def test_reclaim(spark):
    rows = spark.createDataFrame([("1-0", 0), ("2-0", 50), ("3-0", 95), ("4-0", 1)], "message_id string, s long").select("message_id", F.timestamp_seconds("s").alias("delivered_at"))
    assert [r["message_id"] for r in streams.reclaimed(rows, F.timestamp_seconds(F.lit(100)), 30, "1-0", 1).collect()] == ["2-0"]


def test_notes_by_valid_tags(spark):
    notes = spark.createDataFrame([(1, "任务", ["待办"], "t"), (2, "生活", ["日常"], "t")], "id int, type string, tags array<string>, text string")
    assert [r["id"] for r in relational.notes_of(notes, ["id"], 10, note_type="任务").collect()] == [1]
    assert relational.notes_of(notes, ["id"], 10, note_type="外星").count() == relational.notes_of(notes, ["id"], 10, tags=["外星"]).count() == 0
    assert [r["id"] for r in relational.notes_of(notes, ["id"], 900, tags=["日常"]).collect()] == [2]
