"""Structured Streaming forms over a file source, run to the end of the available input."""

from brindle.streaming import streams


def _run(spark, tmp_path, rows, schema, build, mode):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(source)
    stream = spark.readStream.schema(schema).json(source)
    query = build(stream).writeStream.format("memory").queryName(f"out_{mode}_{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(query.name).collect()


def test_watermark_closes_gaps(spark, tmp_path):
    rows = [("a", 1), ("a", 3), ("a", 2), ("b", 2), ("b", 2)]
    found = _run(spark, tmp_path, rows, "space string, seq long", streams.watermarks, "update")
    assert {(r["space"], r["watermark"]) for r in found} == {("a", 3), ("b", 0)}


def test_rate_window_begins_with_the_first_event(spark, tmp_path):
    rows = [("k", i, at) for i, at in enumerate([5, 6, 14, 15, 16])]
    found = _run(spark, tmp_path, rows, "key string, event_id long, at long", lambda s: streams.rate_limit(s, 10, 2), "append")
    assert {r["event_id"]: (r["admitted"], r["retry_after"]) for r in found} == {0: (True, 0), 1: (True, 0), 2: (False, 1), 3: (True, 0), 4: (True, 0)}


def test_rate_windows_over_many_batches_of_a_key(spark, tmp_path):
    n = 25_000
    rows = [("k", i, n - i) for i in range(n)]
    found = _run(spark, tmp_path, rows, "key string, event_id long, at long", lambda s: streams.rate_limit(s, 10, 1), "append")
    assert len(found) == n and {r["event_id"] for r in found if r["admitted"]} == {n - at for at in range(1, n + 1, 10)}


def test_rate_window_goes_on_with_the_next_rows():
    import numpy as np

    (first, _), state = streams.first_event_windows(np.array([0, 3]), 10, 3, None)
    (then, wait), state = streams.first_event_windows(np.array([4, 5, 9, 10]), 10, 3, state)
    assert (first.tolist(), then.tolist(), wait.tolist(), state) == ([True, True], [True, False, False, True], [0, 5, 1, 0], (10, 1))


def test_dedupe_and_windowed_counts(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:30"), ("a", 2, "2024-01-01 00:01:00")]
    schema = "key string, id int, ts timestamp"
    import datetime as dt

    typed = [(k, i, dt.datetime.fromisoformat(t)) for k, i, t in rows]
    found = _run(spark, tmp_path / "one", typed, schema, lambda s: streams.dedupe(s, ["key", "id"], "ts", "10 minutes"), "append")
    assert sorted(r["id"] for r in found) == [1, 2]
    counts = _run(spark, tmp_path / "two", typed, schema, lambda s: streams.windowed_counts(s, "ts", "key", "1 minute", "0 seconds").select("key", "n"), "complete")
    assert sorted(r["n"] for r in counts) == [1, 2]
