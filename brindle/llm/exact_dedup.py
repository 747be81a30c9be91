"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Plan.  One shuffle deals the texts by (hash, text): the text is part of the grouping key, so the
comparison inside a hash group is byte by byte, and the map-side combine sends each distinct text
once per map task however many copies a task has read.  What is kept of that (hash, size, id) is
small; documents meet it by hash alone in a join whose two sides AQE can split, so a group of
copies that holds a third of the rows is not one task.

Defined results.  A null text counts as the empty text and is a group of its own kind with other
empty texts.  A null id ranks below every id; a group of only null ids keeps a null id.  Rows
repeated with the same id and text are one group, of which exactly one row stays.  An empty table
gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import shared_table


def _base(docs: DataFrame, id_column: str, text_column: str, hash_hex: int) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), text.alias("body"), F.substring(F.md5(text.cast("binary")), 1, hash_hex).alias("hash"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_hex: int = 32) -> DataFrame:
    """One row per row of `docs`: id, keep_id (largest id of the group), group_size, kept, text_sha256.

    `hash_hex` is the number of hex digits of the content hash (32: 128 bits); tests lower it to
    force collisions, which the byte comparison must take apart.
    """
    base = _base(docs, id_column, text_column, hash_hex)
    classes = base.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
    classes = shared_table(classes.select("hash", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "group_size", "keep_id"), "exact-classes")
    clashes = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    # The extra deal makes both join inputs plain exchanges, which AQE splits where a hash is hot.
    met = base.select("id", "hash").join(classes.repartition(F.col("keep_id")), "hash")
    if not clashes.isEmpty():
        clashes = shared_table(clashes, "exact-clashes")
        texts = base.join(clashes, "hash", "left_semi")
        apart = texts.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
        apart = texts.join(apart, ["hash", "body"]).withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
        met = met.join(clashes, "hash", "left_anti").unionByName(apart.drop("body"))
    repeats = met.groupBy("id", "text_sha256", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    return repeats.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select(
        F.col("id").alias(id_column), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one whole row of each group of equal texts: the row with the largest id.

    Rows that tie on the id are told apart by their other columns, so the choice is stable.
    """
    names = docs.columns
    place = {c: f"c{i}" for i, c in enumerate(names) if c != text_column}
    others = F.struct(*[F.col(f"`{c}`").alias(name) for c, name in place.items()], F.col(f"`{text_column}`").isNotNull().alias("has"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("body"), others.alias("rest"))
    # Maps have no order of their own; JSON gives every row one.
    order = F.struct("id", F.to_json("rest", {"ignoreNullFields": "false"}).alias("shown"))
    kept = rows.select(F.md5(F.col("body").cast("binary")).alias("hash"), "body", "rest", order.alias("order")).groupBy("hash", "body").agg(F.max_by("rest", "order").alias("rest"))
    back = {c: F.col(f"rest.{name}") for c, name in place.items()} | {text_column: F.when(F.col("rest.has"), F.col("body"))}
    return kept.select(*[back[c].alias(c) for c in names])
