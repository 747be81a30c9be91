"""Versioned evolution of memories: relation guard, stale evidence, idempotent apply, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The relations, actions and reasons that the rules of `relation` give, in their order.
RELATION_COLUMNS = ("relation", "action", "reason", "approved")


def _decision(relation: str, action: str, reason: str, approved: bool) -> Column:
    return F.struct(F.lit(relation).alias("relation"), F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(approved).alias("approved"))


def is_stale(observed: Column, last_evidence: Column) -> Column:
    """Evidence older than what is known; text that is no time counts as stale."""
    new, old = F.try_to_timestamp(observed), F.try_to_timestamp(last_evidence)
    given = (F.coalesce(observed, F.lit("")) != "") & (F.coalesce(last_evidence, F.lit("")) != "")
    return given & F.coalesce(new < old, F.lit(True))


def can_transition(old: Column, new: Column) -> Column:
    """Task states may change between todo and done, and from or to none."""
    return old.isNull() | new.isNull() | (old == new) | ((old == "todo") & (new == "done")) | ((old == "done") & (new == "todo"))


def relation(pair: dict[str, Column]) -> Column:
    """What a candidate means for a memory: a struct of relation, action, reason and approved.

    `pair` names: same_type, memory_type, same_key, stale, instance, values_changed, old_status,
    new_status, closure_differs, metadata_changed, detail, terminal_reactivation, same_scope,
    unconfirmed, correction, old_polarity, new_polarity, same_subject, same_predicate, same_value,
    time_change, negative_claim.  The first rule that holds decides.
    """
    p = pair
    task = (
        F.when(~p["instance"], _decision("new", "insert", "task_requires_exact_canonical_key", False))
        .when(p["values_changed"], _decision("update_task", "update_task", "task_explicit_value_update", True))
        .when(p["old_status"].eqNullSafe(p["new_status"]) & (p["new_status"] == "done") & p["closure_differs"], _decision("conflict", "pending_review", "task_closure_reason_conflict", False))
        .when(p["old_status"].eqNullSafe(p["new_status"]) & p["metadata_changed"], _decision("update_task", "update_task", "task_lifecycle_metadata_update", True))
        .when(p["old_status"].eqNullSafe(p["new_status"]) & p["detail"], _decision("merge", "merge", "task_detail_merge", True))
        .when(p["old_status"].eqNullSafe(p["new_status"]), _decision("same", "add_source", "same_task_identity_and_status", True))
        .when(p["terminal_reactivation"], _decision("conflict", "pending_review", "terminal_task_reactivation_requires_evidence", False))
        .when(can_transition(p["old_status"], p["new_status"]), _decision("update_task", "update_task", "valid_task_state_transition", True))
        .otherwise(_decision("conflict", "pending_review", "invalid_task_state_transition", False))
    )
    semantic = F.when(p["same_key"], _decision("same", "add_source", "same_semantic_fact", True)).otherwise(_decision("new", "insert", "semantic_append_only", True))
    preference = (
        F.when(~p["same_key"] | ~p["same_subject"] | ~p["same_scope"], _decision("new", "insert", "preference_identity_mismatch", False))
        .when(p["unconfirmed"], _decision("conflict", "pending_review", "unconfirmed_preference_change", False))
        .when(p["correction"], _decision("supersede", "update", "explicit_preference_correction", True))
        .when(p["new_polarity"] != p["old_polarity"], _decision("update", "update", "preference_polarity_update", True))
        .when(p["detail"], _decision("merge", "update", "preference_scope_or_detail_merge", True))
        .otherwise(_decision("same", "add_source", "same_preference_identity", True))
    )
    episodic = (
        F.when(~p["same_key"] & p["correction"] & p["same_subject"] & p["same_predicate"], _decision("supersede", "update", "explicit_event_correction_across_topic", True))
        .when(p["same_key"] & (p["unconfirmed"] | (p["negative_claim"] & ~p["correction"])), _decision("conflict", "pending_review", "unconfirmed_or_negative_event_claim", False))
        .when(p["same_key"] & p["correction"], _decision("supersede", "update", "explicit_event_correction", True))
        .when(p["same_key"] & p["same_value"] & p["time_change"], _decision("update", "update", "episodic_time_or_fact_update", True))
        .when(p["same_key"] & p["same_value"] & p["detail"], _decision("merge", "update", "episodic_detail_merge", True))
        .when(p["same_key"] & p["same_value"], _decision("same", "add_source", "same_episodic_event", True))
        .otherwise(_decision("new", "insert", "episodic_requires_exact_duplicate", False))
    )
    return (
        F.when(~p["same_type"], _decision("new", "insert", "memory_type_mismatch", False))
        .when(p["same_key"] & p["stale"], _decision("conflict", "pending_review", "candidate_observed_before_current_memory", False))
        .when(p["memory_type"] == "task", task).when(p["memory_type"] == "semantic", semantic).when(p["memory_type"] == "preference", preference).otherwise(episodic)
    )


def apply_candidates(memories: DataFrame, candidates: DataFrame, applied: DataFrame) -> DataFrame:
    """Idempotent apply of insert and add_source: change rows (key, candidate_id, action, version).

    `memories` has key and current_version, `candidates` has key, candidate_id and at, `applied` has
    candidate_id.  Candidates that were applied before are left out; the first new candidate of an
    unknown key inserts it, all others add a source.
    """
    fresh = candidates.dropDuplicates(["candidate_id"]).join(applied.select("candidate_id"), "candidate_id", "left_anti")
    met = fresh.join(memories.select("key", "current_version"), "key", "left")
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "candidate_id"))
    action = F.when(F.col("current_version").isNull() & (place == 1), "insert").otherwise("add_source")
    return met.select("key", "candidate_id", action.alias("action"), F.coalesce("current_version", F.lit(1)).alias("version"))


def versions(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbered versions of every key with the start of the next as their end."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumns({"version": F.row_number().over(w), "valid_to": F.lead(order[0]).over(w)})


def timeline(memories: DataFrame, history: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """One row per version of each memory, with the number of its sources."""
    n = sources.groupBy(key, "version").agg(F.count(F.lit(1)).alias("n_sources"))
    return memories.select(key).join(history, key).join(n, [key, "version"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def projection(facts: DataFrame, keys: list[str], updated: str, content: str) -> DataFrame:
    """Per key the number of facts, the latest update and the latest content."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_facts"), F.max(updated).alias("updated"), F.max_by(content, F.struct(updated, content)).alias("latest"))


def merge_counts(memories: DataFrame, hits: DataFrame, key: str, count: str) -> DataFrame:
    """Access counts with buffered hits added."""
    more = hits.groupBy(key).agg(F.count(F.lit(1)).alias("more"))
    return memories.join(more, key, "left").select(key, (F.col(count) + F.coalesce("more", F.lit(0))).alias(count))


def due_for_backfill(memories: DataFrame, vectors: DataFrame, key: str, hashed: str) -> DataFrame:
    """Memories whose content hash has no ready vector."""
    return memories.join(vectors.select(key, hashed), [key, hashed], "left_anti")


def retryable(states: DataFrame, asof: Column, lease_seconds: int, max_attempts: int) -> DataFrame:
    """Latest states that may be tried again: failed or partial with attempts left, or a lapsed lease."""
    stale = (F.col("status") == "processing") & (F.unix_micros(asof) - F.unix_micros(F.col("updated")) > lease_seconds * 1_000_000)
    return states.where((F.col("status").isin("pending", "failed", "partial") & (F.col("attempts") < max_attempts)) | stale)
