"""Sources and sinks: tables, JSON logs, append-once, dead letters, migration counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_ahead_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, one message a line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str, schema: StructType, limit: int) -> DataFrame:
    """The newest events of JSON-line logs; malformed lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def note_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def traces_of(traces: DataFrame, memory_id: str) -> DataFrame:
    """Traces with a step whose output names a memory, as such or as a target."""
    named = lambda s: (s["output"]["memory_id"] == memory_id) | (s["output"]["target_memory_id"] == memory_id)
    return traces.where(F.exists("steps", named))


def note_markdown(notes: DataFrame) -> DataFrame:
    """Notes as Markdown blocks, in one text column."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    return notes.select(F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), F.concat(F.lit("tags: "), tags), F.lit(""), F.coalesce("text", F.lit("")), F.lit("")).alias("value"))


def append_once(log: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of `incoming` whose key the log does not have, each key once: the row to append.

    Of rows with one key the first by `order` is taken, then by the row as JSON, so that a repeated run
    appends the same row.  Keys compare as values: rows with a null key are new, once each.
    """
    place = F.struct(*[F.col(c) for c in order or []], F.to_json(F.struct(*incoming.columns), {"ignoreNullFields": "false"}).alias("_row"))
    firsts = incoming.groupBy(*keys).agg(F.min_by(F.struct(*incoming.columns), place).alias("_first")).select(*[F.col(f"_first.`{c}`").alias(c) for c in incoming.columns])
    return firsts.join(log.select(*keys), keys, "left_anti")


def dead_letters(failed: DataFrame, source: str, error: str = "error", width: int = 500) -> DataFrame:
    """Failed rows with their fields as JSON, their source and a clipped error."""
    fields = [c for c in failed.columns if c != error]
    return failed.select(F.to_json(F.struct(*fields)).alias("fields"), F.lit(source).alias("source"), F.substring(error, 1, width).alias("error"))


def migrate(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to insert, and one row of counts: incoming, inserted, present."""
    new = append_once(existing, incoming, keys)
    counts = incoming.agg(F.count(F.lit(1)).alias("incoming")).crossJoin(new.agg(F.count(F.lit(1)).alias("inserted")))
    return new, counts.withColumn("present", F.col("incoming") - F.col("inserted"))


def migration_counts(incoming: DataFrame, inserted: DataFrame, kind: str, failed: Column) -> DataFrame:
    """Per kind of entity how many rows came, were inserted and failed."""
    came = incoming.groupBy(kind).agg(F.count(F.lit(1)).alias("incoming"), F.count_if(failed).alias("failed"))
    new = inserted.groupBy(F.col(kind).alias("of")).agg(F.count(F.lit(1)).alias("inserted"))
    return came.join(new, F.col(kind).eqNullSafe(F.col("of")), "left").select(kind, "incoming", F.coalesce("inserted", F.lit(0)).alias("inserted"), "failed")


def append_feedback(entries: DataFrame, path: str) -> None:
    """Append entries to a log of JSON lines."""
    entries.write.mode("append").json(path)


def feedback(spark: SparkSession, path: str, schema: str, n: int, order: str = "id") -> DataFrame:
    """The newest entries of a log of JSON lines."""
    return spark.read.schema(schema).json(path).orderBy(F.desc(order)).limit(n)


def with_vectors(index: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """An index of vectors with items added; one with a known key takes the place of the old."""
    return index.join(items.select(key), key, "left_anti").unionByName(items)


def without_vectors(index: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """An index of vectors without the keys of `gone`."""
    return index.join(gone.select(key), key, "left_anti")


def seed_notes(spark: SparkSession, n: int) -> DataFrame:
    """Deterministic notes: four types in turn, every tenth linked to the one before, every 20th provisional."""
    kinds = F.array(*[F.lit(k) for k in ("idea", "task", "log", "fact")])
    return spark.range(n).select(
        F.format_string("note_%06d", "id").alias("note_id"), F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("note_type"),
        F.when(F.col("id") % 10 == 9, F.format_string("note_%06d", F.col("id") - 1)).alias("related_id"), F.when(F.col("id") % 20 == 0, "provisional").otherwise("enriched").alias("enrichment_status"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("created_at"),
    )


def load_plan(spark: SparkSession, users: int, messages: int, seed: int) -> DataFrame:
    """A load plan: profiles 70/20/8/2 by user, operations 70/20/5/5 by a seeded hash."""
    rows = spark.range(users).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(0), F.lit(messages - 1))).alias("i"))
    slot, draw = F.col("user") % 100, F.pmod(F.xxhash64(F.lit(seed), "user", "i"), 100)
    profile = F.when(slot < 70, "ordinary").when(slot < 90, "active").when(slot < 98, "burst").otherwise("malicious")
    operation = F.when(draw < 70, "ingest").when(draw < 90, "query").when(draw < 95, "summary").otherwise("memory")
    message = F.when((profile == "malicious") & (F.col("i") % 3 == 2), F.col("i") - 1).otherwise(F.col("i"))
    return rows.select("user", "i", profile.alias("profile"), operation.alias("operation"), F.format_string("m_%d_%d", "user", message).alias("message_id"))
