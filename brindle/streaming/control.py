"""Queue control as state transitions over snapshots: outbox, delivery, cascades, rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff_seconds(attempts: Column) -> Column:
    """1, 2, 4, ... seconds, 300 at most."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))).cast("int")


def ingest_once(messages: DataFrame, keys: list[str], space: str, order: list[str]) -> DataFrame:
    """Each message once, numbered within its space."""
    first = messages.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("copy = 1").drop("copy")
    return first.withColumn("sequence_no", F.row_number().over(Window.partitionBy(space).orderBy(*order)))


def outbox_step(events: DataFrame, asof: Column, succeeded: Column, max_attempts: int) -> DataFrame:
    """The next state of each event that is due: published, retried later, or dead."""
    due = ~F.col("status").isin("published", "dead") & (F.col("available_at").isNull() | (F.col("available_at") <= asof))
    tried = F.col("attempts") + 1
    status = F.when(~due, F.col("status")).when(succeeded, "published").when(tried >= max_attempts, "dead").otherwise("pending")
    wait = F.when(due & ~succeeded & (tried < max_attempts), backoff_seconds(tried))
    return events.select("event_id", F.when(due, tried).otherwise(F.col("attempts")).alias("attempts"), status.alias("status"), wait.alias("wait_seconds"))


def delivery_step(deliveries: DataFrame, asof: Column, lease_seconds: int, max_attempts: int) -> DataFrame:
    """Whether a delivery may be reserved now."""
    lapsed = (F.col("status") == "sending") & (F.unix_seconds(asof) - F.unix_seconds("updated") > lease_seconds)
    free = F.col("status").isin("pending", "failed") | lapsed
    return deliveries.withColumn("reserved", free & (F.col("attempts") < max_attempts) & ~F.col("status").isin("sent", "unknown"))


def cancelled(tasks: DataFrame) -> DataFrame:
    """Blocked tasks whose parent has failed: id and the parent's id."""
    failed = tasks.where(F.col("status") == "failed").select(F.col("id").alias("parent_id"))
    return tasks.where(F.col("status") == "blocked").select("id", "parent_id").join(failed, "parent_id", "left_semi").select("id", "parent_id")


def first_event_limit(events: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Windows that begin with their first event: each event with admitted and retry_after (seconds).

    A window's start depends on the one before, so the events of a key are gone through in order.
    """
    from brindle.streaming.streams import first_event_windows

    rows = events.select(F.col(key).alias("key"), F.col(order).alias("id"), F.unix_seconds(F.col(ts)).alias("at"))

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "id"])
        (admitted, wait), _ = first_event_windows(group["at"].to_numpy(), seconds, limit, None)
        return pd.DataFrame({"id": group["id"], "admitted": admitted, "retry_after": wait})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("key").applyInPandas(step, f"id {kind}, admitted boolean, retry_after long").withColumnRenamed("id", order)


def slots(claims: DataFrame, keys: list[str], at: str, claim: str, ttl_seconds: int, limit: int) -> DataFrame:
    """Claims of slots that lapse: those of a key within the time of one that are before it are still
    held, by claims that were let in; each claim with `held` and `admitted`.

    As a claim is held for one fixed time, slots come free in the order in which they were taken, so
    the number of earlier claims in the last `ttl_seconds` bounds those held; a claim that finds fewer
    than `limit` of them is let in, and so is every claim that finds fewer of them let in.
    """
    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "claim"])
        taken, free, held, admitted = [], 0, [], []
        for now in group["at"]:
            while free < len(taken) and taken[free] + ttl_seconds <= now:
                free += 1
            held.append(len(taken) - free)
            admitted.append(held[-1] < limit)
            if admitted[-1]:
                taken.append(now)
        return pd.DataFrame({"claim": group["claim"], "held": held, "admitted": admitted})

    rows = claims.select(*[F.col(k) for k in keys], F.unix_seconds(F.col(at)).alias("at"), F.col(claim).alias("claim"))
    kind = rows.schema["claim"].dataType.simpleString()
    return rows.groupBy(*keys).applyInPandas(step, f"claim {kind}, held int, admitted boolean").withColumnRenamed("claim", claim)


def task_claims(tasks: DataFrame, asof: Column, lease_seconds: int, worker: str) -> DataFrame:
    """The tasks that a worker may claim now, in their next state: running, one attempt and claim more."""
    lapsed = F.coalesce(F.col("lease_expires_at") <= asof, F.col("started_at").isNull() | (F.unix_seconds(asof) - F.unix_seconds("started_at") >= lease_seconds))
    free = ~F.col("status").isin("blocked", "cancelled", "completed", "dead_letter") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= asof)) & ((F.col("status") != "running") | lapsed)
    return tasks.where(free).withColumns({
        "lost_attempt": F.when(F.col("status") == "running", F.col("attempt_count")), "status": F.lit("running"), "started_at": asof, "attempt_count": F.col("attempt_count") + 1, "claimed_by": F.lit(worker),
        "lease_expires_at": F.timestamp_seconds(F.unix_seconds(asof) + lease_seconds), "claim_version": F.col("claim_version") + 1,
    })


def task_outcomes(tasks: DataFrame, reports: DataFrame, asof: Column) -> DataFrame:
    """Reports on running tasks applied: id, status, failure_count, defer_count, next_retry_at, accepted.

    `reports` has id, lease_token, claim_version, outcome (completed, failed or deferred) and delay
    (seconds).  A report without the lease, or after it, is stale and changes nothing.
    """
    r = reports.select("id", F.col("lease_token").alias("r_token"), F.col("claim_version").alias("r_version"), "outcome", "delay")
    met = tasks.join(r, "id")
    own = (F.col("status") == "running") & (F.col("lease_token") == F.col("r_token")) & (F.col("claim_version") == F.col("r_version")) & (F.col("lease_expires_at") > asof)
    own = F.coalesce(own, F.lit(False))
    failed, deferred = own & (F.col("outcome") == "failed"), own & (F.col("outcome") == "deferred")
    spent = F.col("failure_count") + 1 >= F.col("max_attempts")
    status = F.when(~own, F.col("status")).when(failed & spent, "dead_letter").when(failed | deferred, "retry").otherwise("completed")
    wait = F.timestamp_micros(F.unix_micros(asof) + (F.greatest(F.lit(0.1), F.col("delay")) * 1_000_000).cast("long"))
    return met.select(
        "id", status.alias("status"), (F.col("failure_count") + failed.cast("int")).alias("failure_count"), (F.col("defer_count") + deferred.cast("int")).alias("defer_count"),
        F.when(own, F.when(deferred | (failed & ~spent), wait)).otherwise(F.col("next_retry_at")).alias("next_retry_at"), own.alias("accepted"),
    )


def due_retries(tasks: DataFrame, asof: Column, n: int) -> DataFrame:
    """Tasks whose retry is due, queued again: id and the attempt that is asked for, the longest due first."""
    due = tasks.where((F.col("status") == "retry") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= asof)))
    return due.orderBy(F.asc_nulls_first("next_retry_at"), "created_at", "id").limit(n).select("id", F.lit("queued").alias("status"), (F.col("attempt_count") + 1).alias("attempt"))


def space_progress(spaces: DataFrame, inbox: DataFrame) -> DataFrame:
    """The watermarks of each space after what its inbox says: up to the first message beyond the old
    mark that is neither completed nor failed, or to the last; never back; and the first failed one
    below, as a gap.  `spaces` has space, note_watermark and memory_watermark; `inbox` space,
    sequence_no, note_status and memory_status."""
    met = inbox.join(spaces, "space")

    def mark(stage: str) -> Column:
        beyond, closed = F.col("sequence_no") > F.col(f"{stage}_watermark"), F.col(f"{stage}_status").isin("completed", "failed")
        return F.coalesce(F.min(F.when(beyond & ~closed, F.col("sequence_no"))) - 1, F.max(F.when(beyond, F.col("sequence_no"))))

    seen = met.groupBy("space").agg(mark("note").alias("note"), mark("memory").alias("memory"), F.min(F.when(F.col("memory_status") == "failed", F.col("sequence_no"))).alias("first_failed"))
    new = lambda stage: F.greatest(F.col(f"{stage}_watermark"), F.coalesce(stage, F.col(f"{stage}_watermark")))
    found = spaces.join(seen, "space", "left").select("space", new("note").alias("note_watermark"), new("memory").alias("memory_watermark"), "first_failed")
    return found.withColumn("gap", F.when(F.col("first_failed") <= F.col("memory_watermark"), F.col("first_failed"))).drop("first_failed")


def completed_with_inbox(tasks: DataFrame, done: DataFrame, inbox: DataFrame, spaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks completed together with their inbox rows: the inbox as it is then, the spaces' progress, and
    the blocked tasks that it releases, with the id of the event that asks for each.

    `done` has inbox_id, note and memory (booleans, the stages that completed); `tasks` has id, space,
    status, consistency, required_watermark, attempt_count.
    """
    marks = done.select(F.col("inbox_id").alias("id"), "note", "memory")
    after = inbox.join(marks, "id", "left").withColumns({s: F.when(F.col(s[:-7]), "completed").otherwise(F.col(s)) for s in ("note_status", "memory_status")}).drop("note", "memory")
    touched = after.join(marks.select("id"), "id", "left_semi").select("space").distinct()
    progress = space_progress(spaces.join(touched, "space", "left_semi"), after)
    blocked = tasks.where("status = 'blocked'").join(progress, "space")
    need, kind = F.coalesce("required_watermark", F.lit(0)), F.coalesce("consistency", F.lit("weak"))
    free = ~kind.isin("note", "memory") | ((kind == "note") & (need <= F.col("note_watermark"))) | ((kind == "memory") & (need <= F.col("memory_watermark")))
    event = F.concat(F.lit("event_"), F.md5(F.concat_ws(":", F.col("id").cast("string"), (F.col("attempt_count") + 1).cast("string")).cast("binary")))
    return after, progress, blocked.where(free).select("id", F.lit("queued").alias("status"), event.alias("event_id"))


def skipped_ingress(inbox: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """Messages to be closed so that watermarks go on: blocked as sensitive with an open note, or
    commands whose task will never run: id, reason; the oldest `n` of each."""
    n = max(1, min(n, 5000))
    blocked = inbox.where((F.col("status") == "blocked_sensitive") & ~F.col("note_status").isin("completed", "failed")).orderBy("received_at", "id").limit(n).select("id", F.lit("blocked_sensitive").alias("reason"))
    waiting = tasks.where((F.col("task_type") == "ingest") & F.col("status").isin("blocked", "queued", "retry")).select("message_id").distinct()
    commands = inbox.where((F.col("status") == "pending") & F.startswith("text", F.lit("/"))).join(waiting, "message_id", "left_semi").orderBy("received_at", "id").limit(n).select("id", F.lit("skipped_command").alias("reason"))
    return blocked.unionByName(commands)


def retained(tasks: DataFrame, asof: Column, newest: int, failure_ttl_seconds: int) -> DataFrame:
    """Tasks that a registry keeps: all that are active, the newest finished ones, and failures for a time."""
    active = F.coalesce(F.col("status").isin("queued", "running"), F.lit(False))
    fresh = F.coalesce((F.col("status") == "failed") & (F.unix_seconds(asof) - F.unix_seconds("finished_at") < failure_ttl_seconds), F.lit(False))
    order = [F.desc("finished_at"), F.desc("id")]
    # The newest are cut by a limit, so no task sees all finished rows; those that stay anyway are told apart after it.
    return tasks.where(active | fresh).unionByName(tasks.where(~active).orderBy(*order).limit(newest).where(~fresh))


def due_summaries(subscriptions: DataFrame, deliveries: DataFrame, asof: Column, max_attempts: int = 3) -> DataFrame:
    """Subscriptions whose daily summary is due: after their minute of the day, once a day unless the
    delivery failed with attempts left.  `deliveries` has space, day, status and attempts."""
    day, minute = F.date_format(asof, "yyyy-MM-dd"), F.hour(asof) * 60 + F.minute(asof)
    met = subscriptions.where(F.col("enabled") & (minute >= F.col("minute_of_day"))).withColumn("day", day).join(deliveries, ["space", "day"], "left")
    return met.where(F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < max_attempts))).select("space", "day")


def aligned_limit(events: DataFrame, keys: list[str], ts: str, seconds: int, limit: int, order: list[str]) -> DataFrame:
    """Fixed windows from the epoch: the first `limit` events of a key are let in, each with the
    seconds until its window ends."""
    bucket = F.floor(F.unix_seconds(F.col(ts)) / seconds)
    rows = events.withColumn("bucket", bucket)
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    return rows.withColumns({"admitted": place <= limit, "retry_after": ((F.col("bucket") + 1) * seconds - F.unix_seconds(F.col(ts))).cast("long")})
