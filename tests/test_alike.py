"""Adjudication judges candidates that are alike once, and looks equal texts up once."""

import random

from pyspark.sql import functions as F

from brindle.operators import adjudication as A

CANDIDATE = "candidate_id string, memory_type string, memory_key string, content string, object_value string, confidence double, should_store boolean"


def test_alike_candidates_are_searched_for_once(spark, monkeypatch):
    rows = [(f"c{i:02d}", "episodic", "k1", "昨天开会", "v", i / 20, True) for i in range(20)] + [("d1", "episodic", "k2", None, None, 0.5, True), ("d2", "episodic", "k2", None, None, 0.6, True), ("e1", "episodic", "k1", "不存", "v", 0.3, False)]
    candidates = spark.createDataFrame(rows, CANDIDATE).withColumn("space", F.lit(1))
    memories = spark.createDataFrame([("m1", "episodic", "k1", "昨天开会", "v"), ("m2", "episodic", "k9", "别的事情", "w")], "id string, memory_type string, memory_key string, content string, object_value string")
    memories = memories.withColumns({"space": F.lit(1), "status": F.lit("active"), "current_version": F.lit(2), "updated_at": F.to_timestamp(F.lit("2024-01-01"))})
    searched, search = [], A.neighbours
    monkeypatch.setattr(A, "neighbours", lambda c, m: searched.append(c.count()) or search(c, m))
    found = {r["candidate_id"]: r for r in A.adjudicate(candidates, memories).collect()}
    assert searched == [2] and set(found) == {r[0] for r in rows}
    for i, r in ((i, found[f"c{i:02d}"]) for i in range(20)):
        assert (r["action"], r["target_id"], r["n_targets"], r["confidence"]) == ("add_source", "m1", 1, max(i / 20, 0.92))
    assert [found[i]["action"] for i in ("d1", "d2", "e1")] == ["insert", "insert", "discard"]
    # Against what is given, every candidate is judged by itself, with the same result.
    given = candidates.where("memory_key = 'k1'").select("candidate_id", F.lit("m1").alias("id"))
    assert {r["candidate_id"]: r for r in A.adjudicate(candidates, memories, given).collect()} == found


def test_texts_inside_each_other(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab好") for _ in range(rng.randrange(n)))
    needles, hays = [(rng.randrange(2), f"n{i}", text(13)) for i in range(60)] * 2, [(rng.randrange(2), f"h{i}", text(30)) for i in range(80)]
    found = A._inside(spark.createDataFrame(needles, "space int, needle_id string, needle string"), spark.createDataFrame(hays, "space int, hay_id string, hay string"), ["space"])
    expected = {(n, h) for s, n, a in needles for t, h, b in hays if s == t and len(a) >= 2 and a in b}
    assert expected and {tuple(r) for r in found.collect()} == expected
