"""Lifecycle of memories, candidates and decisions: reviews, corrections, archives and purges as rows of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import rules
from brindle.functions import text as T
from brindle.functions.text import iso_period
from brindle.operators.evolution import can_transition
from brindle.operators.relational import latest_per_key

# Words that reopen a finished task, and how evidence raises a confidence.
REOPENING = ("重新", "再次", "重做", "返工", "恢复", "再开始", "又开始")
RETRYABLE = ("extracted", "validated", "failed", "processing")
APPLIED = ("applied", "pending_review", "discarded")


def merged_content(old: Column, new: Column) -> Column:
    """The longer of two texts if one holds the other, else both, joined."""
    a, b = T.normalize_content(old), T.normalize_content(new)
    both = F.concat(F.regexp_replace(old, "[。；; ]+$", ""), F.lit("；"), F.regexp_replace(F.regexp_replace(new, "^[用户]+", ""), "[。；; ]+$", ""))
    return F.when((a == "") | F.contains(b, a), new).when(F.contains(a, b), old).otherwise(both)


def combined_confidence(candidate: Column, relation: Column) -> Column:
    return 0.6 * candidate + 0.4 * relation


def confirmed_confidence(old: Column, new: Column) -> Column:
    """A confidence after one more confirmation."""
    return F.least(F.lit(0.99), F.greatest(old, old + 0.25 * (new - old) + 0.02))


def archived_duplicates(targets: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Other active tasks with the identity of a task that is done: the versions that archive them, and
    the two relations of each.

    `targets` has id, space and identity of done tasks; `memories` id, space, memory_type, status,
    identity and current_version.
    """
    t = targets.select(F.col("id").alias("target_id"), "space", "identity")
    found = memories.where("memory_type = 'task' AND status = 'active'").join(t, ["space", "identity"]).where("id <> target_id")
    versions = found.select("id", (F.col("current_version") + 1).alias("version"), F.lit("archived").alias("status"), F.lit("duplicate_task_identity_reconciled").alias("reason"))
    edges = F.explode(F.array(F.struct(F.col("target_id").alias("source_id"), F.col("id").alias("target"), F.lit("supersedes").alias("relation")), F.struct(F.col("id").alias("source_id"), F.col("target_id").alias("target"), F.lit("superseded_by").alias("relation"))))
    return versions, found.select(edges.alias("e")).select("e.*")


def decision_log(entries: DataFrame) -> DataFrame:
    """The decisions as first written, with the status, results and error of their last entry.

    `entries` has id, at, status, results and error besides what a decision keeps.
    """
    keep = [c for c in entries.columns if c not in ("id", "at", "status", "results", "error")]
    first = entries.groupBy("id").agg(F.min_by(F.struct(*keep), "at").alias("kept"), F.max_by(F.struct("status", "results", "error"), "at").alias("last"), F.min("at").alias("created_at"))
    return first.select("id", *[F.col(f"kept.{c}") for c in keep], "last.status", "last.results", "last.error", "created_at")


def decisions_of(decisions: DataFrame, note: str | None = None, status: str | None = None, n: int = 50) -> DataFrame:
    """The newest decisions, of a note or status if given."""
    rows = decisions if note is None else decisions.where(F.col("note_id") == note)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(n, 200)))


def relations_of(relations: DataFrame, memory: Column) -> DataFrame:
    """Relations that a memory is an end of, the oldest first."""
    return relations.where((F.col("source_id") == memory) | (F.col("target_id") == memory)).orderBy("created_at", "id")


def newest_traces(traces: DataFrame, n: int) -> DataFrame:
    """The traces that ended, or else began, last, in the order of time."""
    at = F.coalesce("finished_at", "started_at")
    return traces.orderBy(F.desc(at), F.desc("trace_id")).limit(max(1, min(n, 5000))).orderBy(at, "trace_id")


def candidate_states(log: DataFrame) -> DataFrame:
    """Candidates after all marks: first content, last status and error, tries, and when they were settled.

    `log` has candidate_id, at, status, error; the first entry is the candidate as it was saved.
    """
    return log.groupBy("candidate_id").agg(
        F.max_by("status", "at").alias("status"), F.max_by("error", "at").alias("error"), F.count_if(F.col("status") == "processing").alias("attempts"),
        F.max(F.when(F.col("status").isin(*APPLIED), F.col("at"))).alias("applied_at"), F.max("at").alias("updated_at"),
    )


def retryable_candidates(states: DataFrame, n: int = 100) -> DataFrame:
    """Candidates that are not settled, the longest untouched first."""
    return states.where(F.col("status").isin(*RETRYABLE)).orderBy("updated_at", "candidate_id").limit(max(1, min(n, 500)))


def reviewed(pending: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Versions that reviews of pending memories bring: id, version, status, content, task_status, reason.

    `pending` has id, version, content, task_status, confidence, relation, and of the decision's target
    target_id, target_version, target_type, target_content, target_task_status; `verdicts` has id and
    verdict (approve or reject).  A merge or task update goes into the target and archives the pending
    row; a supersession ends the target; a conflict marks both; a new memory becomes active.
    """
    rows = pending.join(verdicts, "id")
    ok, rel = F.col("verdict") == "approve", F.col("relation")
    into = ok & rel.isin("merge", "update_task") & F.col("target_id").isNotNull()
    against = ok & rel.isin("supersede", "conflict") & F.col("target_id").isNotNull()
    own_status = F.when(~ok, "archived").when(into, "archived").when(against & (rel == "conflict"), "conflicted").when(against | (rel == "new"), "active")
    own_reason = F.when(~ok, F.lit("user_rejected_pending_memory")).when(into, F.concat(rel, F.lit("_applied_after_review"))).otherwise("user_approved_pending_memory")
    own = rows.where(own_status.isNotNull()).select("id", (F.col("version") + 1).alias("version"), own_status.alias("status"), "content", "task_status", own_reason.alias("reason"))
    content = F.when(rel == "update_task", F.col("content")).when(rel == "merge", merged_content(F.col("target_content"), F.col("content"))).otherwise(F.col("target_content"))
    status = F.when(into, "active").when(rel == "supersede", "superseded").otherwise("conflicted")
    task = F.when(rel == "update_task", F.col("task_status")).otherwise(F.col("target_task_status"))
    other = rows.where(into | against).select(F.col("target_id").alias("id"), (F.col("target_version") + 1).alias("version"), status.alias("status"), content.alias("content"), task.alias("task_status"), F.concat(F.lit("user_approved_"), rel).alias("reason"))
    return own.unionByName(other)


def corrected(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections of memories: id, version, content, task_status, and error where a task may not change so.

    `corrections` has id, new_content and new_status (or null, then the text says it).  A finished task
    opens again only with words that say so.
    """
    rows = memories.join(corrections, "id")
    new = F.coalesce(rules.legacy_status(F.col("new_status")), rules.status_from_statement(F.col("new_content")), F.col("task_status"))
    new = F.when(F.col("memory_type") == "task", new)
    wrong = F.when((F.col("memory_type") == "task") & ~F.coalesce(can_transition(F.col("task_status"), new), F.lit(True)), "invalid_transition").when(
        (F.col("task_status") == "done") & (new == "todo") & ~rules.any_of(F.col("new_content"), REOPENING), "reopening_needs_wording"
    )
    return rows.select("id", F.when(wrong.isNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(wrong.isNull(), F.col("new_content")).otherwise(F.col("content")).alias("content"), F.when(wrong.isNull(), new).otherwise(F.col("task_status")).alias("task_status"), wrong.alias("error"))


def purged(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of any table without those that name a purged memory (id) in one of the columns."""
    for key in keys:
        rows = rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return rows


def due_runs(spaces: DataFrame, runs: DataFrame, cadence: str, asof: Column, lease_seconds: int) -> DataFrame:
    """The spaces whose run of this period may be reserved: none yet, failed, or running for longer
    than the lease: space, period.  `runs` has space, cadence, period, status and updated_at."""
    period = iso_period(asof, {"daily": "day", "weekly": "week", "monthly": "month"}[cadence])
    mine = latest_per_key(runs.where(F.col("cadence") == cadence).select("space", "period", "status", "updated_at"), ["space", "period"], ["updated_at"])
    stale = (F.col("status") == "running") & (F.unix_seconds(asof) - F.unix_seconds("updated_at") > lease_seconds)
    held = mine.where((F.col("status") != "failed") & ~stale).select("space", "period")
    return spaces.select("space", period.alias("period")).join(held, ["space", "period"], "left_anti")


def is_due(cadence: str, asof: Column) -> Column:
    """Whether a cadence runs on a day: daily always, weekly on Mondays, monthly on the first."""
    return {"daily": F.lit(True), "weekly": F.dayofweek(asof) == 2, "monthly": F.dayofmonth(asof) == 1}[cadence]


def rekeyed(decisions: DataFrame) -> DataFrame:
    """Of the decisions of one candidate the newest keeps its key; the others get one of their own."""
    place = F.row_number().over(Window.partitionBy("space", "candidate_id").orderBy(F.desc("created_at"), F.desc("id")))
    legacy = F.concat_ws(":", F.col("candidate_id").cast("string"), F.lit("legacy"), F.col("id").cast("string"))
    return decisions.withColumn("candidate_key", F.when(place == 1, F.col("candidate_id").cast("string")).otherwise(legacy))
