"""Sharding by jump consistent hashing (Lamping and Veach, 2014), with DataFrame functions only.

The id and the shard count decide the shard; no ring table exists, and one shard more takes rows
only into itself, about 1/(n+1) of them.  A row's slot is its gapless place in its shard in the
order (text hash, id), so equal texts that meet in a shard lie side by side.  Slots need no window
over a shard: rows are dealt by ranges of (shard, text hash, id), numbered inside their partition,
and shifted by the counts of the partitions before, a table with one row per (partition, shard).

Defined results.  A null text has 0 bytes and the checksum of the empty text.  An id that is not a
whole number hashes by the MD5 of its text form; a null id as the text hash, so such rows spread
too.  Repeated rows each take a slot.  Columns of any name may stand beside the id and the text.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import shared_table

# The multiplier of the 64-bit congruential step that jump hashing is published with.
JUMP_MULTIPLIER = 2862933555777941757


def _walk(key: Column, shards: int, steps: int) -> Column:
    """`steps` jumps of a 64-bit key: the last bucket b below `shards`, and the bucket j after it if
    the walk has ended; decimals keep the 64-bit product exact."""
    wide = "decimal(20,0)"
    two64 = F.lit(str(1 << 64)).cast(wide)
    unsigned = F.when(key < 0, key.cast(wide) + two64).otherwise(key.cast(wide)).cast(wide)
    start = F.struct(unsigned.alias("k"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(at: Column, _: Column) -> Column:
        k = ((at["k"] * F.lit(str(JUMP_MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % two64).cast(wide)
        high = F.floor(k / F.lit(str(1 << 33)).cast("decimal(11,0)")).cast("double") + 1.0
        j = F.floor((at["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / high)).cast("long")
        moved = F.struct(k.alias("k"), at["j"].alias("b"), j.alias("j"))
        return F.when(at["j"] < shards, moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: F.struct(at["b"].cast("int").alias("b"), at["j"].alias("j")))


def jump_walk(key: Column, shards: int) -> Column:
    """The walk of a 64-bit key among `shards`: b, its shard, and j, the bucket it jumps to next.

    With one shard more the row moves only if j is that shard.  A walk has about ln(shards) jumps,
    each to a later bucket; the rare row that needs more than a few times that walks on to its end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    few = min(shards, 12 + math.ceil(3 * math.log(shards + 1)))
    short = _walk(key, shards, few)
    return short if few == shards else F.when(short["j"] >= shards, short).otherwise(_walk(key, shards, shards))


def _content(text: Column) -> Column:
    """64 bits of the MD5 of a text, as hex digits."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def shard_rows(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), _content(text).alias("content"))
    of_content = F.conv(F.substring("content", 1, 15), 16, 10).cast("long")
    whole = isinstance(rows.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    of_id = F.col("id").cast("long") if whole else F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("walk", jump_walk(F.coalesce(of_id, of_content), shards))
    rows = rows.select("id", "size", "crc", "content", F.col("walk.b").alias("shard"), F.when(F.col("walk.j") == shards, F.lit(shards)).otherwise(F.col("walk.b")).alias("grown"))
    order = ["shard", "content", "id"]
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = shared_table(dealt.withColumns({"part": F.shiftright(place, 33).cast("int"), "place": place}), "shard-rows")
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = shared_table(counts.select("part", "shard", "first", before.alias("before")), "shard-starts")
    return dealt.join(starts, ["part", "shard"]).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place") - F.col("first")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )
