"""Matching of memories: duplicate episodes, tasks of one identity, relevant evidence, audits of false merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import rules
from brindle.functions import text as T
from brindle.operators.hybrid import memory_score

# Markers of questions about the present and of references, and of facts in focus.
PRESENT = ("现在", "当前", "目前", "到底", "还算", "focus", "主要", "重点")
POINTING = ("那个", "这个", "那件", "这件", "它", "哪个", "哪一个", "哪条", "哪种")
IN_FOCUS = ("当前", "现在", "重点", "主要", "focus")
GENERIC_PREDICATES = ("", "fact", "事实")
EPISODES, MERGE_SCORE, FUZZY_SCORE = 100, 0.72, 0.72


def episode_merges(memories: DataFrame, asof: Column, min_score: float = MERGE_SCORE, newest: int = EPISODES) -> DataFrame:
    """Duplicate episodes of a space: keeper_id, merged_id, score.

    The newest episodes of a space are gone through in order; each that was not merged itself takes in
    all others, not merged yet, that score high enough for its content.  What one takes in depends on
    those before, so the bounded list of a space meets in one task.
    """
    rows = memories.where("status = 'active' AND memory_type = 'episodic'")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("space").orderBy(F.desc("updated_at"), F.desc("id")))).where(F.col("place") <= newest)
    keepers = rows.select("space", F.col("id").alias("keeper_id"), F.col("content").alias("keeper"), F.col("place").alias("keeper_place"))
    scored = rows.join(keepers, "space").where("id <> keeper_id").withColumn("score", memory_score(F.col("keeper"), asof)).where(F.col("score") >= min_score)
    pairs = scored.select("space", "keeper_id", "keeper_place", F.col("id").alias("merged_id"), F.col("place").alias("merged_place"), "score")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        gone, kept = set(), []
        for r in group.sort_values(["keeper_place", "merged_place"]).itertuples():
            if r.keeper_id not in gone and r.merged_id not in gone:
                gone.add(r.merged_id)
                kept.append((r.keeper_id, r.merged_id, r.score))
        return pd.DataFrame(kept, columns=["keeper_id", "merged_id", "score"])

    kind = pairs.schema["keeper_id"].dataType.simpleString()
    return pairs.groupBy("space").applyInPandas(pick, f"keeper_id {kind}, merged_id {kind}, score double")


def _topic(prefix: str) -> Column:
    """The longest of a task's topic, predicate, value and content, as a key."""
    parts = [T.normalize_content(F.coalesce(F.col(f"{prefix}{c}"), F.lit(""))) for c in ("canonical_topic", "predicate", "object_value", "content")]
    best = parts[0]
    for p in parts[1:]:
        best = F.when(F.length(p) > F.length(best), p).otherwise(best)
    return F.replace(best, F.lit("的"), F.lit(""))


def topic_similarity(a: Column, b: Column) -> Column:
    """1 for topics of which one ends with the other, else the overlap of their characters."""
    sets = [F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "") for x in (a, b)]
    return F.when((a == "") | (b == ""), 0.0).when(F.endswith(a, b) | F.endswith(b, a), 1.0).otherwise(T.jaccard(*sets))


def task_matches(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Active tasks that a candidate task may be the same as: candidate_id, id, kind, score, rank.

    Both have memory_key, subject, predicate, object_value, content, canonical_topic, operation, scope
    and space; `memories` also id, status and updated_at.  Kinds, best first: the exact key, equal
    structure, an attribute that ends with the other's, and a like topic of the same subject.  Task
    families are not looked at.
    """
    columns = ("memory_key", "subject", "predicate", "object_value", "content", "canonical_topic", "operation", "scope")
    c = candidates.select("candidate_id", "space", *[F.col(x).alias(f"c_{x}") for x in columns])
    pairs = memories.where("status = 'active' AND memory_type = 'task'").join(c, "space")
    norm = lambda x, empty="": T.normalize_content(F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit(empty)))
    same = lambda x, empty="": norm(x, empty) == norm(f"c_{x}", empty)
    structured = same("subject") & same("predicate") & same("operation") & (F.coalesce(F.col("c_subject"), F.lit("")) != "") & (F.coalesce(F.col("c_predicate"), F.lit("")) != "")
    a, b = F.replace(norm("c_predicate"), F.lit("的"), F.lit("")), F.replace(norm("predicate"), F.lit("的"), F.lit(""))
    like = topic_similarity(_topic("c_"), _topic(""))
    found = (
        F.when(F.col("c_memory_key") == F.col("memory_key"), F.struct(F.lit("exact_key").alias("kind"), F.lit(4).alias("order"), F.lit(1.0).alias("score")))
        .when(structured, F.struct(F.lit("structured_identity").alias("kind"), F.lit(3).alias("order"), F.lit(0.98).alias("score")))
        .when(same("subject") & (F.endswith(a, b) | F.endswith(b, a)), F.struct(F.lit("identity_compatible").alias("kind"), F.lit(2).alias("order"), F.lit(0.94).alias("score")))
        .when(same("subject") & (like >= FUZZY_SCORE), F.struct(F.lit("fuzzy_topic").alias("kind"), F.lit(1).alias("order"), like.alias("score")))
    )
    hits = pairs.where(same("scope", "global")).withColumn("found", found).where(F.col("found").isNotNull())
    best = Window.partitionBy("candidate_id").orderBy(F.desc("found.order"), F.desc("found.score"), F.desc("updated_at"), F.desc("id"))
    return hits.select("candidate_id", "id", "found.kind", "found.score", F.row_number().over(best).alias("rank"))


def query_overlap(query: Column, *parts: Column) -> Column:
    """The share of a question's search terms that some texts have."""
    q, c = T.lexical_terms(query), T.lexical_terms(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def relevant_evidence(hits: DataFrame, floor: float = 0.70) -> DataFrame:
    """The hits of each question that may serve as evidence: `hits` with overlap.

    A hit stays with a high score, near a very high best score, with a fair score and overlap, as a
    fact in focus for a question about the present, or as what a pointing question may mean.  `hits`
    has query_id, query, score and the columns of a memory.
    """
    value = T.casefold(T.squeeze(F.regexp_replace(F.trim("query"), "[?？]+$", "")))
    overlap = query_overlap(F.col("query"), *[F.col(c) for c in ("content", "subject", "predicate", "object_value", "memory_key", "task_status", "memory_type")])
    top = F.max("score").over(Window.partitionBy("query_id"))
    rows = hits.withColumns({"overlap": overlap, "_top": top})
    fair = F.col("score") >= 0.45
    content = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("object_value", F.lit("")))
    keep = (
        (F.col("score") >= floor) | ((F.lit(floor) <= 0) & (F.col("overlap") >= 0.12)) | ((F.col("_top") >= 0.90) & (F.col("score") >= F.greatest(F.lit(0.45), F.col("_top") - 0.25))) | (fair & (F.col("overlap") >= 0.20))
        | (fair & rules.any_of(value, PRESENT) & (F.col("memory_type") == "semantic") & rules.any_of(content, IN_FOCUS)) | (fair & rules.any_of(value, POINTING) & (F.col("overlap") >= 0.08))
    )
    return rows.where(keep).drop("_top")


def merge_audit(memories: DataFrame, current_version: str) -> DataFrame:
    """Memories that may have been merged wrongly: id, reason; each reason once.

    `memories` has id, memory_type, memory_key, key_version, predicate, status and n_sources.
    """
    several = F.col("n_sources") > 1
    generic = memories.where((F.col("memory_type") == "semantic") & T.normalize_content(F.coalesce("predicate", F.lit(""))).isin(*GENERIC_PREDICATES) & several).select("id", F.lit("generic_semantic_fact_multiple_sources").alias("reason"))
    legacy = memories.where((F.col("memory_type") == "task") & (F.col("key_version") != current_version) & several).select("id", F.lit("legacy_task_key_multiple_sources").alias("reason"))
    active = memories.where("status = 'active'")
    shared = active.groupBy("memory_type", "memory_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key_version") == current_version).alias("n_current")).where("n > 1 AND n_current > 0")
    same_key = active.join(shared, ["memory_type", "memory_key"], "left_semi").select("id", F.lit("duplicate_active_canonical_key").alias("reason"))
    return generic.unionByName(legacy).unionByName(same_key).distinct()


def audit_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def next_sequences(messages: DataFrame, log: DataFrame, space: str, order: list[str]) -> DataFrame:
    """New messages numbered on from the largest number that their space has: `messages` with sequence_no."""
    last = log.groupBy(space).agg(F.max("sequence_no").alias("_last"))
    place = F.row_number().over(Window.partitionBy(space).orderBy(*order))
    return messages.join(last, space, "left").withColumn("sequence_no", F.coalesce("_last", F.lit(0)) + place).drop("_last")


def watermark_probe(log: DataFrame, marks: DataFrame, space: str, seq: str, is_open: Column) -> DataFrame:
    """Per space the first open number beyond its mark and the last number beyond it: space, first_open, last."""
    beyond = F.col(seq) > F.col("watermark")
    return log.join(marks.select(space, "watermark"), space).groupBy(space).agg(F.min(F.when(beyond & is_open, F.col(seq))).alias("first_open"), F.max(F.when(beyond, F.col(seq))).alias("last"))
