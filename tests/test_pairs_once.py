"""All queries go to a memory at once: texts do not leave a join once for each query, and tests left out change no flag."""

import random
from functools import reduce

from pyspark.sql import functions as F

from brindle.functions import terms
from brindle.functions import text as T
from brindle.operators import hybrid
from tests.plans import join_rows

MEMORY = "id long, memory_type string, content string, memory_key string, subject string, predicate string, object_value string, updated_at long"
FLAGS = ["is_exact", "is_lexical", "is_matched", "fts_rank"]


def _plain(asked, memories):
    """The flags by their definitions, each pair by itself."""
    q, slots = F.col("query"), ("content", "subject", "predicate", "object_value")
    pairs = asked.crossJoin(memories).withColumns({"ts": terms.memory_terms(q), "part": F.trim("query"), "ids": terms.identifiers(q)})
    pairs = pairs.withColumn("qs", F.array_distinct(terms.lexemes(F.substring(F.when(F.size("ts") > 0, F.array_join("ts", " ")).otherwise(q), 1, hybrid.QUERY_WORDS))))
    pairs = pairs.withColumn("ws", terms.lexemes(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in slots])))
    some = lambda *tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    given = F.col("part") != ""
    exact = some(
        given & (F.col("memory_key") == F.col("part")), given & terms.like_any(F.col("content"), F.array("part"), 160), T.normalize_content(F.col("content")) == T.normalize_content(q),
        *[terms.has_identifier(F.col(c), F.col("ids")) for c in ("memory_key", "subject", "object_value", "content")],
    )
    matched = terms.plain_match(F.col("ws"), F.col("qs"))
    values = [exact, some(*[terms.like_any(F.col(c), F.col("ts"), 120) for c in slots]), matched, F.when(matched, terms.rank_cover(F.col("ws"), F.col("qs")))]
    return {(r[0], r[1]): tuple(r[2:]) for r in pairs.select("query_id", "id", *[v.alias(f) for f, v in zip(FLAGS, values)]).collect()}


def test_flags_are_those_of_each_pair_by_itself(spark):
    rng = random.Random(11)
    words, marks = ["a", "the", "that", "thé", "key-1", "TASK-12", "咖啡", "我现在", "任务", "进展", "如何", "ΟΔΟΣ", "Straße", "x1", "目前"], [" ", "  ", ", ", "-", "\n", "_", "", "!"]
    say = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    texts = [None, "", "?!", "目前" * 300 + "the", "!" * 600 + "the", "the" + "!" * 600, *[say(rng.randrange(0, 40)) for _ in range(90)]]
    rows = [(i, "task", t, rng.choice([None, "key-1", say(1)]), rng.choice([None, say(2)]), say(1), rng.choice([None, "", say(2)]), i) for i, t in enumerate(texts)]
    questions = [None, "", " ", "!", "the", "that the", "任务进展如何", "key-1 the", *[say(rng.randrange(1, 5)) for _ in range(12)], *[t for t in texts[6:16] if t]]
    asked, memories = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string"), spark.createDataFrame(rows, MEMORY)
    found = {(r[0], r[1]): tuple(r[2:]) for r in hybrid.memory_pairs(asked, memories).select("query_id", "id", *FLAGS).collect()}
    expected = _plain(asked, memories)
    assert found == expected and len(found) == len(rows) * len(questions)
    assert all(sum(bool(v[i]) for v in expected.values()) > 20 for i in range(len(FLAGS)))
    assert hybrid.memory_pairs(asked.where("false"), memories).count() == 0


def test_a_text_leaves_the_join_once(spark):
    memories = spark.range(50).selectExpr("id", "'task' AS memory_type", "concat('text of ', id) AS content", "'k' AS memory_key", "'s' AS subject", "'p' AS predicate", "'o' AS object_value", "id AS updated_at")
    asked = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "query_id int, query string")
    rows, most = join_rows(hybrid.memory_pairs(asked, memories).select("query_id", "id", *FLAGS))
    assert len(rows) == 350 and most == 50
