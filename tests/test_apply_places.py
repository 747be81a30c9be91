"""Decisions without a target do not meet in one task."""

from brindle.operators import adjudication as A
from tests.plans import largest_shares
from tests.test_adjudication import CANDIDATE, MEMORY


def test_inserts_are_spread(spark):
    names = lambda schema: [c.strip().split(" ") for c in schema.split(",")]
    own = {"candidate_id": "concat('c', id)", "note_id": "id", "space": "id % 3", "at": "id", "memory_type": "'task'", "memory_key": "concat('k', id)", "content": "concat('text ', id)"}
    candidates = spark.range(4000).selectExpr(*[f"CAST({own.get(n, 'NULL')} AS {t}) AS {n}" for n, t in names(CANDIDATE)])
    known = {**own, "id": "concat('m', id)", "status": "'active'", "current_version": "3"}
    memories = spark.range(400).selectExpr(*[f"CAST({known.get(n, 'NULL')} AS {t}) AS {n}" for n, t in names(MEMORY)])
    decisions = candidates.selectExpr("candidate_id", "if(note_id % 2 = 0, 'insert', 'update') AS action", "'r' AS relation", "'why' AS reason", "if(note_id % 2 = 0, NULL, concat('m', note_id % 400)) AS target_id", "3 AS snapshot_version", "0.9D AS confidence")
    none = candidates.where("false")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = A.apply_decisions(decisions, candidates, memories, none.selectExpr("'m' AS memory_id", "note_id", "'r' AS relation"), none.select("candidate_id"))["decisions"]
        shares = largest_shares(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shares and max(shares) < 0.3
