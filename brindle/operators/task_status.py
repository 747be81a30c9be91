"""How a task stands: the tasks that a question names, then the events that explain them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators.hybrid import search_memories

# What a question about a task says beside the task, in the order of removal.
NOISE = (
    "用户", "我", "当前", "现在", "最近", "这件", "这个", "那个",
    "任务", "事项", "事宜", "情况", "进展", "状态", "怎么样", "如何",
    "吗", "呢", "了", "的",
)
# The fields of a scope that belong to what a memory is about, those that name a family of
# tasks, the score that a hit needs where no task is named, and most events.
SCOPE_FIELDS = ("canonical_topic", "task_family_key", "related_task_family_key")
FAMILY_FIELDS = ("task_family_key", "related_task_family_key")
UNNAMED_SCORE, EVENTS = 0.62, 2


def anchor(query: Column) -> Column:
    """What a question names: its parts between blanks, normalised, without what is said beside it, those of
    two characters or more once, joined; empty where it names nothing."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), r"[\s\x0B]+"), lambda p: p != "")
    bare = F.transform(parts, lambda p: reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), NOISE, T.normalize_content(p)))
    return F.array_join(F.array_distinct(F.filter(bare, lambda p: F.length(p) >= 2)), "")


def identity_text(scope: str = "scope") -> Column:
    """All that says what a memory is about, normalised; its scope is JSON, or null."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("content", "subject", "predicate", "object_value", "memory_key")]
    return T.normalize_content(F.concat_ws(" ", *given, *[F.coalesce(F.get_json_object(scope, f"$.{f}"), F.lit("")) for f in SCOPE_FIELDS]))


def task_status_search(queries: DataFrame, memories: DataFrame, asof: Column, limit: int = 8) -> DataFrame:
    """The tasks of each question, best first, and up to two events after them: query_id, id, role, rank.

    A task counts if what the question names is part of what it is about or, where it names nothing, by its
    score.  An event also counts if it belongs to the family of a task that counts.  `memories` has the
    columns of `search_memories`, and scope.  Only the hits of the two searches are looked at again, and
    those of a question are a number set by `limit`.
    """
    limit = max(1, min(int(limit), 20))
    asked = queries.select("query_id", anchor(F.col("query")).alias("anchor"))
    families = F.array_distinct(F.filter(F.array(*[F.coalesce(F.get_json_object("scope", f"$.{f}"), F.lit("")) for f in FAMILY_FIELDS]), lambda f: f != ""))

    def hits(kind: str, most: int) -> DataFrame:
        own = memories.where(F.col("memory_type") == kind)
        found = F.broadcast(search_memories(queries, own, asof, most, 0.0)).join(own, "id").join(F.broadcast(asked), "query_id")
        named = F.when(F.col("anchor") != "", F.contains(identity_text(), F.col("anchor"))).otherwise(F.col("final") >= UNNAMED_SCORE)
        return found.select("query_id", "id", "rank", named.alias("named"), families.alias("families"), F.coalesce(F.get_json_object("scope", "$.related_task_family_key"), F.lit("")).alias("related"))

    both = hits("task", max(3 * limit, 12)).withColumn("part", F.lit(0)).unionByName(hits("episodic", max(2 * limit, 8)).withColumn("part", F.lit(1)))
    # The hits of a question are few, so the families of its tasks are told by a window over them; no search runs twice.
    known = F.flatten(F.collect_list(F.when(F.col("named") & (F.col("part") == 0), F.col("families"))).over(Window.partitionBy("query_id")))
    counts = F.col("named") | ((F.col("part") == 1) & F.array_contains("known", F.col("related")))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by[0]).orderBy(*by[1]))
    kept = both.withColumn("known", known).where(counts).withColumn("n", place(["query_id", "part"], ["rank"])).where((F.col("part") == 0) | (F.col("n") <= EVENTS))
    role = F.when(F.col("part") == 0, "current_task").otherwise("historical_event")
    return kept.withColumn("rank", place(["query_id"], ["part", "n"])).where(F.col("rank") <= limit).select("query_id", "id", role.alias("role"), "rank")
