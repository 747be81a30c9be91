"""Structured Streaming forms: dedupe, contiguous watermarks, first-event rate windows, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe(messages: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Each message once within the lateness that is waited for."""
    return messages.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def watermarks(log: DataFrame) -> DataFrame:
    """Per space the last sequence number up to which all are closed, kept up as messages close.

    `log` has space (string) and seq (long) of closed messages, in any order; a message is closed when
    it is completed or failed, so one that fails for good does not hold the others back.  The state of
    a space is its watermark and the closed numbers beyond the first gap, which are as many as the
    messages that overtake the one it waits for.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ahead = state.get if state.exists else (0, [])
        seen = set(ahead)
        for batch in batches:
            seen.update(int(s) for s in batch["seq"])
        while mark + 1 in seen:
            mark += 1
            seen.discard(mark)
        state.update((mark, sorted(s for s in seen if s > mark)))
        yield pd.DataFrame({"space": [key[0]], "watermark": [mark]})

    return log.groupBy("space").applyInPandasWithState(step, "space string, watermark long", "mark long, ahead array<long>", "update", GroupStateTimeout.NoTimeout)


def first_event_windows(at: np.ndarray, seconds: int, limit: int, before: tuple[int, int] | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[int, int]]:
    """Which of the sorted times of one key are let in, and the seconds until the others may come, in
    windows that begin with their first event; and the start and count of the last window.

    `before` is that of the rows before.  The loop takes a step a window, not an event.
    """
    admitted, wait = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
    low, (start, used) = 0, before if before is not None else (None, 0)
    while low < len(at):
        if start is None or at[low] >= start + seconds:
            start, used = int(at[low]), 0
        high = int(np.searchsorted(at, start + seconds, side="left"))
        free = max(0, limit - used)
        admitted[low : min(high, low + free)] = True
        wait[low + min(free, high - low) : high] = start + seconds - at[low + min(free, high - low) : high]
        used += high - low
        low = high
    return (admitted, wait), (int(start) if start is not None else 0, int(used))


def rate_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Windows that begin with the first event of a key: each event with whether it is let in.

    `events` has key (string), event_id (long) and at (long, seconds).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The rows of a key come in several batches; their order counts over all of them.
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out, last = first_event_windows(rows["at"].to_numpy(), seconds, limit, state.get if state.exists else None)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "admitted": out[0], "retry_after": out[1]})
        state.update(last)

    return events.groupBy("key").applyInPandasWithState(step, "key string, event_id long, admitted boolean, retry_after long", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def task_streams(spark: SparkSession, paths: dict[str, str], schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Several task streams (folders of JSON lines, by task type) as one, with task_type; a trigger reads
    a bounded number of files of each, and the checkpoint keeps what was read."""
    found = None
    for name, path in paths.items():
        one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path).withColumn("task_type", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def append_to(stream: DataFrame, path: str, checkpoint: str, keep_days: int | None = None, ts: str = "ts"):
    """A running query that appends a stream to a table; with `keep_days`, rows older than the newest
    of their batch by more are left out, as a stream of bounded length would have dropped them."""

    def write(batch: DataFrame, _: int) -> None:
        if keep_days is not None:
            newest = batch.agg(F.max(ts).alias("newest"))
            batch = batch.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("newest") - F.expr(f"INTERVAL {int(keep_days)} DAYS")).drop("newest")
        batch.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reclaimed(pending: DataFrame, asof: Column, min_idle_seconds: int, after: str, n: int) -> DataFrame:
    """Delivered messages that no consumer has confirmed for some time, in the order of their ids from
    `after` on, `n` at most: the ids to take over; the last id is the next cursor."""
    idle = F.unix_seconds(asof) - F.unix_seconds("delivered_at") >= min_idle_seconds
    return pending.where(idle & (F.col("message_id") > after)).orderBy("message_id").limit(n)


def debounced(changes: DataFrame, key: str, ts: str, seconds: int, asof: Column) -> DataFrame:
    """Keys that have been dirty for some time: key, dirty_since, due.  The wait runs from the first
    change, so a key that keeps changing is not put off."""
    first = changes.groupBy(key).agg(F.min(ts).alias("dirty_since"))
    return first.withColumn("due", F.unix_seconds(asof) - F.unix_seconds("dirty_since") >= seconds)


def with_dead_letters(stream: DataFrame, good: Column, good_path: str, dead_path: str, checkpoint: str, source: str = "stream", error: Column | None = None, width: int = 500):
    """A running query that writes good rows to one table and the rest to another: their fields as
    JSON, the source and the error, clipped."""

    def write(batch: DataFrame, _: int) -> None:
        batch.where(good).write.mode("append").parquet(good_path)
        rest = batch.where(~F.coalesce(good, F.lit(False)))
        why = F.substring(F.lit("rejected") if error is None else error, 1, width)
        rest.select(F.to_json(F.struct(*rest.columns)).alias("fields"), F.lit(source).alias("source"), why.alias("error")).write.mode("append").parquet(dead_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, lateness: str) -> DataFrame:
    """Counts per key and event-time window."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
