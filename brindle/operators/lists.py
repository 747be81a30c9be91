"""List tools: business sorts, one row per identity, diversified lists, profiles and histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import rules
from brindle.operators.relational import clamp, latest_per_key, newest

# Markers of listing questions, of tasks and of episodes in them; the bonuses of a spread list.
LISTING = ("列出", "列举", "分别", "概括", "汇总", "有哪些", "哪几", "几件", "几个")
LISTS_TASKS, LISTS_EPISODES = ("项目", "任务", "状态"), ("经历", "事件", "最近记录", "几件")
NEW_IDENTITY, NEW_TYPE, WANTED_KIND = 0.08, 0.05, 0.16
# The order of task states, and the pattern of a state written in a text.
STATE_ORDER = {"todo": 5, "blocked": 4, "done": 3, "canceled": 2, "cancelled": 2, "pending_review": 1, "pending": 1, "active": 0}
WRITTEN_STATE = r"(?i)(?:[:：=]|当前(?:状态)?(?:是|为)?|现在(?:状态)?(?:是|为)?)\s*(todo|blocked|done|canceled|cancelled|pending_review|pending)\b"
WRITTEN_DATE = r"20\d{2}-\d{1,2}-\d{1,2}"


def _get(rows: DataFrame, name: str) -> Column:
    """A column as text, empty where the frame lacks it or it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def _sources(rows: DataFrame) -> Column:
    return F.size("sources") if "sources" in rows.columns else F.lit(0)


def business_times(rows: DataFrame) -> list[Column]:
    """The times that order episodes, first to last: of the event, of validity, written in the content,
    of update and of creation; empty text where there is none."""
    def latest(*names: str) -> Column:
        known = [F.date_format(F.try_to_timestamp(_get(rows, n)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for n in names]
        return F.coalesce(F.greatest(*known, F.lit("")), F.lit(""))

    written = F.try_to_timestamp(F.regexp_extract(_get(rows, "content"), WRITTEN_DATE, 0), F.lit("yyyy-M-d"))
    return [latest("event_time", "event_at", "business_time"), latest("valid_from"), F.coalesce(F.date_format(written, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), latest("updated_at"), latest("created_at")]


def completeness(rows: DataFrame) -> Column:
    """How much of an item is filled in, 0 to 8."""
    given = lambda *names: F.greatest(*[(_get(rows, n) != "").cast("int") for n in names], F.lit(0))
    versions = (F.size("versions") > 0).cast("int") if "versions" in rows.columns else F.lit(0)
    return given("memory_type") + given("canonical_topic", "memory_key", "object_value") + given("task_status", "status") + 2 * given("current_value") + given("content") + (_sources(rows) > 0).cast("int") + versions


def business_score(rows: DataFrame) -> Column:
    """The fields that order business items, as a struct to be sorted downwards."""
    content, current, status = _get(rows, "content"), _get(rows, "current_value"), _get(rows, "task_status")
    source_text = F.array_join("sources", " ") if "sources" in rows.columns else F.lit("")
    written = F.concat_ws(" ", content, source_text, current, _get(rows, "object_value")).rlike(WRITTEN_STATE)
    value = F.when(_get(rows, "object_value") != "", _get(rows, "object_value")).otherwise(current)
    signal = (current != "") | written | ((status != "") & (F.lower(value) == F.lower(status)))
    explicit = signal | rules.any_of(content, ("当前", "现在")) | rules.any_of(source_text, ("当前", "现在", "是todo", "是blocked", "是done"))
    topic = F.lit("")
    for name in ("content", "object_value", "memory_key", "canonical_topic"):
        topic = F.when(_get(rows, name) != "", _get(rows, name)).otherwise(topic)
    repeated = (topic != "") & (F.contains(content, topic) | F.contains(source_text, topic))
    times = business_times(rows)
    first_time = F.coalesce(*[F.nullif(t, F.lit("")) for t in times], F.lit(""))
    order = F.lit(0)
    for name, place in STATE_ORDER.items():
        order = F.when(status == name, place).otherwise(order)
    related = (~(F.contains(content, F.lit("无关")) | F.contains(source_text, F.lit("无关")))).cast("int")
    return F.struct(signal.cast("int").alias("signal"), explicit.cast("int").alias("explicit"), completeness(rows).alias("complete"), _sources(rows).alias("sources"), related.alias("related"), repeated.cast("int").alias("repeated"), order.alias("state"), first_time.alias("time"), _get(rows, "updated_at").alias("updated"))


def identity(rows: DataFrame) -> Column:
    """What an item is about: its topic, else its key, value, id or content."""
    found = F.lit("")
    for name in ("content", "id", "object_value", "memory_key", "canonical_topic"):
        found = F.when(_get(rows, name) != "", _get(rows, name)).otherwise(found)
    return found


def business_sorted(rows: DataFrame, limit: int) -> DataFrame:
    """The best row of each identity in business order, the id rising on ties: `rows` with rank."""
    limit = clamp(limit, 1, 100)
    scored = rows.withColumns({"_score": business_score(rows), "_identity": identity(rows)})
    # Of equal scores the smaller id counts as better.
    best = scored.withColumn("_place", F.row_number().over(Window.partitionBy("_identity").orderBy(F.desc("_score"), "id"))).where("_place = 1")
    top = best.orderBy(F.desc("_score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_score"), "id"))).drop("_score", "_identity", "_place")


def task_list(memories: DataFrame, limit: int = 30, status: str | None = None) -> DataFrame:
    """Active tasks among the newest, of one state if given, in business order."""
    rows = newest(memories.where("status = 'active' AND memory_type = 'task'"), ["updated_at", "id"], max(4 * clamp(limit, 1, 100), 30))
    return business_sorted(rows if status is None else rows.where(F.col("task_status") == status), limit)


def recent_episodes(memories: DataFrame, limit: int = 10) -> DataFrame:
    """Active episodes among the newest, by business time, completeness and update."""
    limit = clamp(limit, 1, 100)
    rows = newest(memories.where("status = 'active' AND memory_type = 'episodic'"), ["updated_at", "id"], max(4 * limit, 30))
    order = [*[F.desc(t) for t in business_times(rows)], F.desc(completeness(rows)), F.desc("updated_at"), F.asc("id")]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def profile(hits: DataFrame, limit: int) -> DataFrame:
    """The best hits of each memory type: `hits` with rank."""
    best = Window.partitionBy("memory_type").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= clamp(limit, 1, 10))


def history(hits: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions of one hit: that with most of them if any has several, then by overlap, score and update.

    `hits` has id, overlap, score and updated_at; a hit that is not the first needs an overlap of 0.12.
    """
    counts = versions.groupBy("id").agg(F.count(F.lit(1)).alias("n_versions"))
    first = hits.orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id")).limit(1).select(F.col("id").alias("first_id"))
    kept = hits.crossJoin(first).where((F.col("overlap") >= 0.12) | (F.col("id") == F.col("first_id")))
    one = kept.join(counts, "id").orderBy(F.desc("n_versions"), F.desc("overlap"), F.desc("score"), F.desc("updated_at"), F.desc("id")).limit(1)
    return versions.join(one.select("id"), "id", "left_semi")


def stale_history(memories: DataFrame, versions: DataFrame, floor: float = 0.08, least: float = 0.45) -> DataFrame:
    """Versions of memories that are no longer active and overlap with the question: id, version, score."""
    rows = memories.where((F.col("status") != "active") & (F.col("overlap") >= floor)).select("id", F.greatest(F.lit(least), F.col("overlap")).alias("score"))
    return versions.join(rows, "id").select("id", "version", "score")


def cover(hits: DataFrame, limit: int) -> DataFrame:
    """Hits in order; those of a listing question spread over identities and types, one pick at a time:
    query_id, id, rank.

    `hits` has query_id, query, id, score, memory_type, identity and stated (a task with its state).
    A query's hits are bounded by its retrieval, so they meet in one task.
    """
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        query = str(group["query"].iloc[0] or "")
        rows = group.sort_values(["score", "id"], ascending=False, kind="stable").reset_index(drop=True)
        if any(m in query for m in LISTING):
            wanted = (rows["memory_type"] == "task") & rows["stated"] if any(m in query for m in LISTS_TASKS) else pd.Series(False, index=rows.index)
            told = rows["memory_type"] == "episodic" if any(m in query for m in LISTS_EPISODES) else pd.Series(False, index=rows.index)
            base = rows["score"] + WANTED_KIND * wanted.astype(float) + WANTED_KIND * told.astype(float)
            left, chosen, identities, types = list(rows.index), [], set(), set()
            while left and len(chosen) < limit:
                value = lambda i: (round(base[i] + NEW_IDENTITY * (rows.at[i, "identity"] not in identities) + NEW_TYPE * bool(rows.at[i, "memory_type"] and rows.at[i, "memory_type"] not in types), 12), rows.at[i, "score"], str(rows.at[i, "id"]))
                best = max(left, key=value)
                left.remove(best)
                chosen.append(best)
                identities.add(rows.at[best, "identity"])
                types.add(rows.at[best, "memory_type"])
            rows = rows.loc[chosen]
        rows = rows.head(limit)
        return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "rank": range(1, len(rows) + 1)})

    kind, name = hits.schema["id"].dataType.simpleString(), hits.schema["query_id"].dataType.simpleString()
    return hits.groupBy("query_id").applyInPandas(pick, f"query_id {name}, id {kind}, rank int")


def current_profile(memories: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Per memory type the newest row of each identity, at most `caps` of a type: `memories` with place."""
    rows = memories.where("status = 'active'").withColumn("_identity", identity(memories))
    best = latest_per_key(rows, ["memory_type", "_identity"], ["updated_at", "id"])
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("memory_type").orderBy(F.desc("updated_at"), F.desc("id"))))
    most = F.lit(0)
    for name, n in caps.items():
        most = F.when(F.col("memory_type") == name, n).otherwise(most)
    return placed.where(F.col("place") <= most).drop("_identity")
