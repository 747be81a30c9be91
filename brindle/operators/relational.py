"""Relational access paths: filters, joins, top-k, aggregates and windows over plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.sensitive import is_sensitive


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, int(n)))


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in falling order of the columns; the last column must be unique."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def note_filter(notes: DataFrame, condition: Column, order: list[str], n: int, text: str = "text", sensitive=is_sensitive) -> DataFrame:
    """Matching notes, newest first: four times n are fetched, sensitive ones dropped, n kept."""
    return newest(newest(notes.where(condition), order, 4 * n).where(~sensitive(F.col(text))), order, n)


def notes_of(notes: DataFrame, order: list[str], n: int, note_type: str | None = None, tags: list[str] | None = None, since: Column | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Notes by type, tags (all of them), time and status, newest first, 1 to 100 of them; a type or tag
    that is not listed finds nothing."""
    from brindle.functions.rules import GLOBAL_TAGS, NOTE_TYPES, TYPE_TAGS

    known = set(GLOBAL_TAGS).union(*TYPE_TAGS.values())
    tags = [t.strip().lstrip("#") for t in tags or []]
    condition = F.lit((note_type is None or note_type.strip() in NOTE_TYPES) and set(tags) <= known)
    if note_type is not None:
        condition = condition & (F.col("type") == note_type.strip())
    if tags:
        condition = condition & (F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    if since is not None:
        condition = condition & (F.col("created_at") >= since)
    if statuses:
        condition = condition & F.col("status").isin(statuses)
    return note_filter(notes, condition, order, clamp(n, 1, 100))


def with_all_tags(bridge: DataFrame, item: str, tag: str, wanted: list[str]) -> DataFrame:
    """Items that have every wanted tag (relational division)."""
    return bridge.where(F.col(tag).isin(wanted)).groupBy(item).agg(F.countDistinct(tag).alias("n_tags")).where(F.col("n_tags") == len(set(wanted)))


def live(status: str, valid_until: str, asof: Column) -> Column:
    """Active and not past its validity."""
    return (F.col(status) == "active") & (F.col(valid_until).isNull() | (F.col(valid_until) > asof))


def expired_versions(memories: DataFrame, asof: Column) -> DataFrame:
    """The version rows that expire active memories past their validity."""
    due = memories.where((F.col("status") == "active") & (F.col("valid_until") <= asof))
    return due.select("memory_id", (F.col("current_version") + 1).alias("version"), F.lit("expired").alias("status"), F.col("valid_until"))


def allowed(sensitivity: Column, scope: Column, owner: Column, requester: Column, allow_sensitive: Column, allow_restricted: Column) -> Column:
    """Row-level access: sensitive, restricted and owner-only rows need a right or their owner."""
    scope = F.coalesce(F.nullif(F.lower(scope), F.lit("")), F.lit("owner"))
    secret = F.lower(F.coalesce(sensitivity, F.lit(""))).isin("sensitive", "secret", "restricted", "high")
    own = owner.isNull() | (owner == "") | (owner == requester)
    return F.coalesce(
        F.when(secret & ~allow_sensitive, F.lit(False)).when(scope.isin("restricted", "private") & ~allow_restricted, F.lit(False)).when(scope.isin("owner", "owner_only"), own).otherwise(F.lit(True)),
        F.lit(False),
    )


def attach_list(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], item: str, name: str) -> DataFrame:
    """Parents with an ordered list of their children's items; an empty list where there are none."""
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("item")))).alias(name))
    found = parents.join(lists, key, "left")
    return found.withColumn(name, F.coalesce(F.transform(name, lambda x: x["item"].cast("string")), F.array().cast("array<string>")))


def neighbours(nodes: DataFrame, edges: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Up to n edges each way of every node (id): outbound to `known` targets, inbound from all.

    `edges` has source, target and at; edges are cut by (at, other end).
    """
    out = edges.join(known.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("other"), "at", F.lit("out").alias("way"))
    into = edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "at", F.lit("in").alias("way"))
    both = out.unionByName(into).join(nodes.select("id"), "id", "left_semi")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id", "way").orderBy("at", "other"))).where(F.col("rank") <= n)


def previous_of_sender(messages: DataFrame, window: int, n: int, space: str = "space", seq: str = "seq", sender: str = "sender") -> DataFrame:
    """The up to n latest earlier messages of a message's sender among the `window` rows before it.

    Two windows instead of a range join: places in the space bound the look-back, and the sender's
    own earlier rows are read by lag.
    """
    placed = messages.withColumn("place", F.row_number().over(Window.partitionBy(space).orderBy(seq)))
    mine = Window.partitionBy(space, sender).orderBy(seq)
    lags = F.array(*[F.struct(F.lit(-i).alias("offset"), F.lag(seq, i).over(mine).alias("prev"), F.lag("place", i).over(mine).alias("at")) for i in range(1, n + 1)])
    found = placed.withColumn("lags", lags).select("*", F.explode("lags").alias("x"))
    return found.where(F.col("x.prev").isNotNull() & (F.col("place") - F.col("x.at") <= window)).select(space, seq, sender, F.col("x.offset").alias("offset"), F.col("x.prev").alias("prev_seq"))


def lag_behind(spaces: DataFrame, log: DataFrame, key: str, seq: str, watermark: str) -> DataFrame:
    """Each space with the largest sequence of its log and its lag, at least 0."""
    latest = log.groupBy(key).agg(F.max(seq).alias("latest"))
    return spaces.join(latest, key, "left").select(key, F.coalesce("latest", F.lit(0)).alias("latest"), F.greatest(F.coalesce("latest", F.lit(0)) - F.col(watermark), F.lit(0)).alias("lag"))


def rollup_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by the first key, by the second, and in all, in one pass: key name, key, count."""
    pairs = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    keyed = F.explode(F.array(F.struct(F.lit(first).alias("by"), F.col(first).cast("string").alias("key")), F.struct(F.lit(second).alias("by"), F.col(second).cast("string").alias("key")), F.struct(F.lit("all").alias("by"), F.lit("").alias("key"))))
    return pairs.select(keyed.alias("k"), "n").groupBy("k.by", "k.key").agg(F.sum("n").alias("n"))


def largest_cluster(rows: DataFrame, key: str, updated: str, at_least: int) -> DataFrame:
    """The key with the most rows, then the latest update; none if it has too few rows."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.max(updated).alias("updated"))
    return sizes.orderBy(F.desc("size"), F.desc("updated"), key).limit(1).where(F.col("size") >= at_least)


def gated_clusters(rows: DataFrame, keys: list[str], polarity: str, source: str, at_least: int, importance: str, confidence: str) -> DataFrame:
    """Clusters of enough rows and sources, and of one polarity at most."""
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.countDistinct(polarity).alias("polarities"), F.countDistinct(source).alias("sources"), F.max(importance).alias("importance"), F.least(F.lit(0.9), F.max(confidence)).alias("confidence")
    )
    return found.where((F.col("size") >= at_least) & (F.col("polarities") <= 1) & (F.col("sources") >= at_least))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key: the largest by the order columns, by aggregation alone."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("rest"))).alias("top"))
    return top.select(*keys, *[F.col(f"top.rest.{c}").alias(c) for c in rest])


def contiguous_watermark(log: DataFrame, key: str, seq: str, is_open: Column) -> DataFrame:
    """Per space the last sequence before the first open one, or the last of all."""
    seen = log.groupBy(key).agg(F.min(F.when(is_open, F.col(seq))).alias("first_open"), F.max(seq).alias("latest"))
    return seen.select(key, F.coalesce(F.col("first_open") - 1, F.col("latest")).alias("watermark"), "latest")


def released(tasks: DataFrame, watermarks: DataFrame, key: str, required: str) -> DataFrame:
    """Blocked tasks whose required watermark their space has reached."""
    return tasks.join(watermarks, key).where(F.col("watermark") >= F.col(required))


def budget_prefix(rows: DataFrame, keys: list[str], by: str, size: Column, budget: int, descending: bool = True) -> DataFrame:
    """The first rows of each group, in the order of a number, whose sizes add up to no more than the
    budget; rows of equal number follow each other in the order of their other columns.

    Sums of ranges of the number come first, so a large group is added up by several tasks.
    """
    from brindle.functions.scores import ranges

    sized = rows.withColumns({"_size": size, "_range": -ranges(rows, by) if descending else ranges(rows, by)})
    sums = sized.groupBy(*keys, "_range").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_sum")
    starts = sums.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("_range").alias("of_range"), before.alias("_before")).where(F.col("_before") <= budget)
    same = F.col("_range") == F.col("of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    ties = [F.col(c) for c, kind in rows.dtypes if c not in (*keys, by) and not kind.startswith("map")]
    running = F.sum("_size").over(Window.partitionBy(*keys, "_range").orderBy(F.desc(by) if descending else F.asc(by), *ties).rowsBetween(Window.unboundedPreceding, 0))
    met = sized.join(starts, same).withColumn("used", F.col("_before") + running)
    return met.where(F.col("used") <= budget).drop("_size", "_range", "_before", "of_range", *[f"of_{k}" for k in keys])


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Ordered union: of rows with one key, that of the earliest part stays."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("part"))).where("rank = 1").drop("rank")


def time_range(ts: Column, asof: Column, name: str) -> Column:
    """start <= ts < end for a named range that ends with the day of `asof`, or yesterday."""
    days = {"today": 1, "yesterday": 1, "week": 7, "month": 30, "half_year": 183, "year": 365}[name]
    day = F.date_trunc("DAY", asof)
    end = day if name == "yesterday" else F.timestamp_add("DAY", F.lit(1), day)
    return (ts >= F.timestamp_add("DAY", F.lit(-days), end)) & (ts < end)


def provisional(notes: DataFrame) -> DataFrame:
    """Notes whose enrichment is not done."""
    return notes.where(F.col("enrichment_status").isin("provisional", "enriching", "failed"))


def pending_enrichments(notes: DataFrame, created: str, max_attempts: int, n: int) -> DataFrame:
    """Notes to be enriched, the oldest first: not done, with tries left, not sensitive."""
    return provisional(notes).where((F.col("attempts") < max_attempts) & (F.col("sensitivity") == "normal")).orderBy(created).limit(max(1, n))


def ready_vectors(active: DataFrame, vectors: DataFrame) -> DataFrame:
    """The number of ready vectors of active memories, in one row."""
    return vectors.join(active, "id").agg(F.count(F.lit(1)).alias("ready"))


def unpublished(outbox: DataFrame, tasks: DataFrame) -> DataFrame:
    """The number of events of tasks that are neither published nor dead, in one row."""
    return outbox.where(F.col("published_at").isNull() & (F.col("status") != "dead")).join(tasks, "id").agg(F.count(F.lit(1)).alias("unpublished"))
