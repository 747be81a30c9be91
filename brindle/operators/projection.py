"""Profiles of spaces kept up by revisions: facets marked dirty by changes, rebuilt alone, saved by compare-and-set.

A projection is one row of (space, facet): target_revision counts the changes that it must show,
processed_revision those that it shows; it is dirty while the second is behind.  Facts (space, facet,
id, content, importance, confidence, updated_at) are the active semantic memories; facets with null as
their name count as "other".  Which facts a projection was built from is a table of its own, a row a
fact, so a facet with a third of all facts is never one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["space", "facet"]
SCHEMA = "space string, facet string, summary string, current_ids string, fact_count long, truncated_count long, processed_revision long, target_revision long, status string, dirty_since timestamp, updated_at timestamp"
# Most facts and characters that a facet is built from, the width of one fact, the ids that it
# names, the facts and characters of a summary, the blank characters, and the mark of facts not yet in it.
MOST_FACTS, BUDGET, WIDTH, IDS, SUMMED, SUMMARY_WIDTH = 24, 6000, 480, 8, 4, 500
BLANKS, NEWEST_MARK = " \t\r\n\x0b\x0c", "【最新】"
DEBOUNCE_SECONDS, MAX_AGE_SECONDS = 60, 86400


def facet_name(predicate: Column) -> Column:
    """The facet of a memory: its predicate, or `other` where that is blank."""
    name = F.trim(F.coalesce(predicate, F.lit("")), F.lit(BLANKS))
    return F.when(name == "", "other").otherwise(name)


def mark_dirty(projections: DataFrame, changes: DataFrame, asof: Column) -> DataFrame:
    """Projections after changes (space, facet; a row each): every change raises the target by one.

    Changes are counted before they are shuffled.  A facet that was dirty keeps the time since when.
    """
    n = changes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    met = projections.join(n, KEYS, "full_outer")
    hit = F.col("n").isNotNull()
    return met.withColumns({
        "processed_revision": F.coalesce("processed_revision", F.lit(0)).cast("long"),
        "target_revision": F.coalesce("target_revision", F.lit(0)).cast("long") + F.coalesce("n", F.lit(0)),
        "status": F.when(hit, "dirty").otherwise(F.col("status")),
        "dirty_since": F.when(hit, F.coalesce("dirty_since", asof)).otherwise(F.col("dirty_since")),
        "updated_at": F.when(hit, asof).otherwise(F.col("updated_at")),
    }).select(*projections.columns)


def rebuild_tasks(before: DataFrame, after: DataFrame) -> DataFrame:
    """The tasks that a step of `mark_dirty` or `expire` asks for, one a revision: space, facet,
    target_revision and the key under which a repeated request is the same task."""
    old = before.select(*KEYS, F.col("target_revision").alias("old"))
    met = after.join(old, KEYS, "left").withColumn("old", F.coalesce("old", F.lit(0))).where(F.col("target_revision") > F.col("old"))
    each = met.select(*KEYS, F.explode(F.sequence(F.col("old") + 1, F.col("target_revision"))).alias("target_revision"))
    return each.withColumn("idempotency_key", F.concat_ws(":", F.lit("semantic-profile"), "space", "facet", F.col("target_revision").cast("string")))


def wait_seconds(asof: Column, debounce: int = DEBOUNCE_SECONDS) -> Column:
    """Seconds until a projection may be rebuilt: counted from its first change, so that one that keeps
    changing is not put off; 0 for one that is fresh or has no time."""
    behind = F.col("processed_revision") < F.col("target_revision")
    passed = (F.unix_micros(asof) - F.unix_micros("dirty_since")) / F.lit(1e6)
    return F.when(behind & F.col("dirty_since").isNotNull(), F.greatest(F.lit(0.0), F.lit(float(debounce)) - passed)).otherwise(F.lit(0.0))


def due(projections: DataFrame, asof: Column, debounce: int = DEBOUNCE_SECONDS) -> DataFrame:
    """Facets to rebuild now, with the revision that they are rebuilt for: space, facet, expected_revision."""
    behind = F.col("processed_revision") < F.col("target_revision")
    return projections.where(behind & (wait_seconds(asof, debounce) <= 0)).select(*KEYS, F.col("target_revision").alias("expected_revision"))


def packed(facts: DataFrame, keys: list[str], budget: int = BUDGET, most: int = MOST_FACTS, length: Column | None = None) -> DataFrame:
    """The newest facts of each key that fit into a number and a budget of characters, with their place.

    A long fact counts as its cut form and a mark; the first that does not fit ends the list.  `length`
    is that of a fact's content, where that was cut before.  The newest `most` of each key are cut
    within each partition before the shuffle, so a key with a third of all facts sends no more than others.
    """
    newest = [F.desc_nulls_last(c) for c in ("updated_at", "importance", "confidence", "id")]
    top = facts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("place") <= most)
    length = F.length(F.coalesce("content", F.lit(""))) if length is None else length
    size = F.when(length > WIDTH, WIDTH + 1).otherwise(length).cast("long")
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumns({"size": size, "upto": upto}).where((F.col("upto") <= budget) & (F.col("upto") - F.col("size") < budget)).drop("size", "upto")


def build(facts: DataFrame, asked: DataFrame, budget: int = BUDGET, most: int = MOST_FACTS) -> DataFrame:
    """What the asked facets (of `due`) hold now: expected_revision, summary, current_ids (with commas),
    fact_count, truncated_count.  A facet that has lost all its facts is empty.

    Facts are counted and cut within their partitions before they meet what is asked, so no fact beyond
    the newest of a facet is shuffled, and of those only what a summary can show.
    """
    plain = F.substring(F.trim(F.coalesce("content", F.lit("")), F.lit(BLANKS)), 1, SUMMARY_WIDTH)
    counts = facts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("fact_count"))
    shown = facts.select(*KEYS, "id", "importance", "confidence", "updated_at", F.length(F.coalesce("content", F.lit(""))).alias("length"), plain.alias("line"))
    item = F.struct("place", F.col("id").cast("string").alias("id"), F.when(F.col("place") <= SUMMED, F.col("line")).alias("line"))
    lists = packed(shown, KEYS, budget, most, F.col("length")).groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("items"))
    lines = F.filter(F.transform("items", lambda i: i["line"]), lambda x: F.coalesce(x, F.lit("")) != "")
    found = asked.join(counts, KEYS, "left").join(lists, KEYS, "left")
    return found.select(
        *KEYS, "expected_revision", F.coalesce(F.substring(F.array_join(lines, "；"), 1, SUMMARY_WIDTH), F.lit("")).alias("summary"),
        F.coalesce(F.array_join(F.transform(F.slice("items", 1, IDS), lambda i: i["id"]), ","), F.lit("")).alias("current_ids"),
        F.coalesce("fact_count", F.lit(0)).cast("long").alias("fact_count"), (F.coalesce("fact_count", F.lit(0)) - F.coalesce(F.size("items"), F.lit(0))).cast("long").alias("truncated_count"),
    )


def save(projections: DataFrame, built: DataFrame, asof: Column) -> DataFrame:
    """Projections after results of `build`: one is taken unless a later revision was saved before, and
    leaves the facet dirty where changes came while it was built.  Results of facets that are not there
    are left out."""
    b = built.select(*KEYS, F.col("expected_revision"), *[F.col(c).alias(f"b_{c}") for c in ("summary", "current_ids", "fact_count", "truncated_count")])
    met = projections.join(b, KEYS, "left")
    won = F.coalesce(F.col("processed_revision") <= F.col("expected_revision"), F.lit(False))
    fresh = won & (F.col("target_revision") <= F.col("expected_revision"))
    return met.select(
        *KEYS, *[F.when(won, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in ("summary", "current_ids", "fact_count", "truncated_count")],
        F.when(won, F.col("expected_revision")).otherwise(F.col("processed_revision")).alias("processed_revision"), "target_revision",
        F.when(fresh, "fresh").when(won, "dirty").otherwise(F.col("status")).alias("status"), F.when(~fresh, F.col("dirty_since")).alias("dirty_since"),
        F.when(won, asof).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def sources_after(sources: DataFrame, facts: DataFrame, saved: DataFrame) -> DataFrame:
    """The rows (space, facet, id) that say what projections were built from, after those of `saved`
    (space, facet) were built from `facts`."""
    kept = sources.join(saved.select(*KEYS), KEYS, "left_anti").select(*KEYS, "id")
    return kept.unionByName(facts.join(saved.select(*KEYS), KEYS, "left_semi").select(*KEYS, "id"))


def expire(projections: DataFrame, asof: Column, n: int, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Projections of which the `n` oldest fresh ones past their age ask to be rebuilt."""
    old = projections.where((F.col("status") == "fresh") & (F.unix_seconds(asof) - F.unix_seconds("updated_at") > max(60, max_age_seconds)))
    marked = mark_dirty(projections, old.orderBy("updated_at", *KEYS).limit(max(1, n)).select(*KEYS), asof)
    return marked


def uninitialized(projections: DataFrame, n: int) -> DataFrame:
    """Facets that were marked but never built, the longest waiting first: space, facet, target_revision."""
    never = projections.where((F.col("status") == "dirty") & (F.col("processed_revision") == 0))
    return never.orderBy(F.asc_nulls_last("dirty_since"), "space", "facet").limit(max(1, n)).select(*KEYS, F.greatest("target_revision", F.lit(1)).alias("target_revision"))


def profile_lines(projections: DataFrame, sources: DataFrame, facts: DataFrame, budget: int = BUDGET, most: int = 10) -> DataFrame:
    """The lines of each space's profile: space, line_no, line.

    By facet its summary, then, where it is behind or not there, the five newest facts that it was not
    built from, marked; equal lines once, the first `most`.
    """
    state = projections.select(*KEYS, "summary", (F.col("processed_revision") < F.col("target_revision")).alias("behind"))
    open_ = facts.join(state.select(*KEYS, "behind"), KEYS, "left").where(F.coalesce("behind", F.lit(True)))
    fresh = open_.join(sources.select(*KEYS, "id"), [*KEYS, "id"], "left_anti")
    deltas = packed(fresh, KEYS, budget, 5).select(*KEYS, "place", F.concat(F.lit(NEWEST_MARK), F.coalesce("content", F.lit(""))).alias("line"))
    sums = state.where(F.coalesce("summary", F.lit("")) != "").join(facts.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, F.lit(0).alias("place"), F.col("summary").alias("line"))
    first = sums.unionByName(deltas).groupBy("space", "line").agg(F.min(F.struct("facet", "place")).alias("at"))
    numbered = first.withColumn("line_no", F.row_number().over(Window.partitionBy("space").orderBy("at", "line")))
    return numbered.where(F.col("line_no") <= most).select("space", "line_no", "line")
