"""Searches over pairs of query and memory: words in spaced texts, short keys, work done once a text."""

import random

from pyspark.sql import functions as F

from brindle.functions import terms
from brindle.functions import text as T
from brindle.operators import hybrid

MEMORY = "id long, memory_type string, content string, memory_key string, subject string, predicate string, object_value string, updated_at long"


def test_spaced_texts_equal_arrays_of_words(spark):
    rng = random.Random(3)
    vocabulary, marks = ["a", "b", "the", "thé", "c1", "咖啡", "x", "ΟΔΟΣ"], [" ", "  ", ", ", "-", "\n", "_"]
    texts = [None, "", "?!", "the", *["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(300)]]
    rows = [(t, rng.sample(["a", "b", "the", "c1", "咖啡"], rng.randrange(0, 4))) for t in texts]
    frame = spark.createDataFrame(rows, "t string, q array<string>").select("t", "q", terms.lexemes(F.col("t")).alias("ws"), terms.spaced(F.col("t")).alias("s"))
    frame = frame.select(terms.plain_match(F.col("ws"), F.col("q")).alias("m0"), terms.spaced_match(F.col("s"), F.col("q")).alias("m1"), terms.rank_cover(F.col("ws"), F.col("q")).alias("r0"), terms.spaced_rank(F.col("s"), F.col("q")).alias("r1"))
    found = frame.collect()
    assert all(r["m0"] == r["m1"] and r["r0"] == r["r1"] for r in found) and sum(r["r0"] > 0 for r in found) > 100


def test_texts_longer_than_a_key_are_told_by_their_beginning(spark):
    rows = [("我现在用户Tea, house",), ("tea-house" + "!" * 900,), ("tea house" * 200,), ("!" * 600 + "tea house",), ("目前" * 300 + "TEA house",), ("Straße",), (None,)]
    frame = spark.createDataFrame(rows, "t string").select(T.normalize_content(F.col("t")).alias("key"), T.least_length(F.substring(F.lower(F.coalesce("t", F.lit(""))), 1, 512)).alias("least"))
    assert all(r["least"] <= len(r["key"]) for r in frame.collect())
    memories = spark.createDataFrame([(i, "task", t, f"k{i}", None, None, None, i) for i, (t,) in enumerate(rows)], MEMORY)
    asked = spark.createDataFrame([(1, "Tea house"), (2, "strasse")], "query_id int, query string")
    exact = hybrid.memory_pairs(asked, memories).where("is_exact").select("query_id", "id").collect()
    assert sorted(map(tuple, exact)) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 5)]


def test_queries_go_to_the_rows(spark):
    """The small side is sent, so no text is read or cut again for a part of the queries, and hits fetch their memories without moving the others."""
    memories = spark.range(10).selectExpr("id", "'task' AS memory_type", "'x' AS content", "'k' AS memory_key", "'s' AS subject", "'p' AS predicate", "'o' AS object_value", "id AS updated_at")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = hybrid.memory_hits(spark.createDataFrame([(1, "x")], "query_id int, query string"), memories)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
