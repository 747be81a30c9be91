"""Quality rules: base rules on one text, then line frequency across the documents of a host.

DataFrame functions only.  A line is normalised (lower case, white space squeezed, ends trimmed)
and hashed; per host, the number of different texts with the line is counted, exact copies of a
text counting once.  A line above the limit is boilerplate and leaves every document of the host
except the one with the smallest id, so the last copy of a line is never lost.  A document whose
words are then below the least number is depleted and rejected; so is one that fails a base rule.
`judged` counts what leaves; `clean` takes the lines out of the texts and the rejected rows away.

Plan.  The texts are scanned once into a table of features and line hashes in the shared folder;
the two distributed counts, the lookup of frequent lines and the sums run on that table.  Counting
groups by (host, line, text) first, so a line that a third of the documents share is combined on
the map side.  Frequent lines are looked up by broadcast only if the planner finds their table,
whose size is known because it is written, below its broadcast limit; else by a shuffle join.

Defined results.  A null or empty text has no words and fails.  A null host is a host of its own.
Repeated rows get equal verdicts.  Columns of any name may stand beside those used.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import WORD_PATTERN, drop_table, shared_table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOL_PATTERN = "[#*$%&|<>]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: White space other than the line feed.
BLANK_PATTERN = r"[\x20\x09\x0B-\x0D]+"
#: A line is boilerplate above this many different texts of a host and this share of them.
LINE_MIN_TEXTS = 5
LINE_SHARE = 0.1


def _paired(hashes: Column, by: int) -> Column:
    """From the hash of `by` items at each place, the hash of twice as many; `hashes` must be a plain column."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeating_places(placed: Column) -> Column:
    """From windows as (hash, place) in order: the places whose hash an equal neighbour has too."""
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
    before = F.concat(none, placed)
    after = F.concat(F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0))), none)
    near = F.arrays_zip(placed.alias("at"), before.alias("b"), after.alias("a"))
    hit = F.filter(near, lambda z: (z["at"]["h"] == z["b"]["h"]) | (z["at"]["h"] == z["a"]["h"]))
    return F.array_sort(F.transform(hit, lambda z: z["at"]["i"]))


def _covered(places: Column) -> Column:
    """Words in windows at `places`, each word once: a window covers up to the next one at most."""
    n = F.size(places)
    gaps = F.zip_with(F.slice(places, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(places, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.least(F.lit(WINDOW), q - p))
    return F.aggregate(gaps, F.when(n > 0, F.lit(WINDOW)).otherwise(F.lit(0)), lambda s, x: s + x)


def _norm_lines(body: str) -> Column:
    """The normalised lines of the column `body`, empty ones too, as many as it has between line feeds."""
    return F.transform(F.split(F.regexp_replace(F.lower(body), BLANK_PATTERN, " "), "\n"), lambda x: F.trim(x))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """A row per row of `docs`: id, host, text hash, base counts, and lines (hash, words) in order.

    Each step is a projection of its own, used more than once by the next, so that it is evaluated
    once; the sort by place runs only where a window repeats.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(host_column).cast("string").alias("host"), text.alias("body"))
    rows = rows.withColumns({
        "text64": F.xxhash64("body"),
        "words": F.filter(F.split("body", SPACE_PATTERN), lambda w: w != ""),
        "raw_lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD_PATTERN)),
        "n_symbols": (F.length("body") - F.length(F.regexp_replace("body", SYMBOL_PATTERN, ""))).cast("long"),
        "norm_lines": F.filter(_norm_lines("body"), lambda x: x != ""),
    })
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "lines": F.transform("norm_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"))),
    })
    for by in (1, 2, 4):
        rows = rows.withColumn("hashes", _paired(F.col("hashes"), by))
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    rows = rows.withColumn("placed", F.when(repeats, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("places", F.when(F.col("placed").isNotNull(), _repeating_places(F.col("placed"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("n_repeat_words", _covered(F.col("places")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("id", "host", "text64", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "lines")


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", share: float = LINE_SHARE, made: list[DataFrame] | None = None) -> DataFrame:
    """A row per row of `docs`: id, host, text64, the base counts, removed_words, kept, and the hashes of the lines that leave.

    With a `share` of 0 the limit is a count alone: a line above it stays above it however large the host.
    `made`, where given, gets the tables in the shared folder that the result reads.
    """
    found = features(docs, id_column, text_column, host_column).withColumn("row", F.monotonically_increasing_id())
    found = shared_table(found, "quality-features")
    host = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("null")).alias("host")
    lines = found.select("row", "id", host, "text64", F.explode("lines").alias("line"))
    once = lines.groupBy("host", F.col("line.h").alias("h"), "text64").agg(F.min("id").alias("carrier"))
    counted = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("texts"), F.min("carrier").alias("carrier")).where(F.col("texts") > LINE_MIN_TEXTS)
    sizes = found.groupBy(host, "text64").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    frequent = shared_table(counted.join(sizes, "host").where(F.col("texts") > share * F.col("host_texts")).select("host", "h", "carrier"), "quality-lines")
    if made is not None:
        made += [found, frequent]
    hit = lines.select("row", "id", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w")).join(frequent, ["host", "h"])
    removed = hit.where(~F.col("id").eqNullSafe(F.col("carrier"))).groupBy("row").agg(F.sum("w").cast("long").alias("removed_words"), F.collect_set("h").alias("gone"))
    out = found.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < MIN_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row")


def keep_passed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """`docs` without the rows that the rules reject, all columns kept as they are."""
    rejected = judged(docs, id_column, text_column, host_column).where(~F.col("kept")).select(
        F.col("id").alias("rejected_id"), F.col("text64").alias("rejected_text"), F.col("host").alias("rejected_host")
    )
    rejected = shared_table(rejected.distinct(), "quality-rejected")
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in place.items()])
    text64 = F.xxhash64(F.coalesce(rows[place[text_column]], F.lit("")))
    same = rows[place[id_column]].eqNullSafe(rejected["rejected_id"]) & (text64 == rejected["rejected_text"]) & rows[place[host_column]].cast("string").eqNullSafe(rejected["rejected_host"])
    return rows.join(rejected, same, "left_anti").select(*[F.col(name).alias(c) for c, name in place.items()])


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", length_column: str | None = None, share: float = 0.0) -> DataFrame:
    """`docs` without the rows that the rules reject and, in the others, without the lines that leave.

    The lines that stay are kept as they are and in their order; texts without such lines, and all
    other columns, are not touched, but `length_column`, where given, gets the new length of a text
    that lost lines.  The documents are always joined by shuffle: the rows that change grow with them.
    """
    made: list[DataFrame] = []
    verdicts = judged(docs, id_column, text_column, host_column, share, made).where(~F.col("kept") | F.col("gone").isNotNull())
    changed = verdicts.select(F.col("id").alias("changed_id"), F.col("text64").alias("changed_text"), F.col("host").alias("changed_host"), "kept", F.when(F.col("kept"), F.col("gone")).alias("gone"))
    # Rows of equal id, text and host have equal verdicts and lines.
    changed = shared_table(changed.dropDuplicates(["changed_id", "changed_text", "changed_host"]).withColumnsRenamed({"kept": "changed_kept", "gone": "changed_gone"}), "quality-changed")
    for spent in made:
        drop_table(spent)
    # Columns are numbered, so that none of `docs` can clash with the names used here.
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in place.items()])
    text = F.col(place[text_column])
    same = rows[place[id_column]].eqNullSafe(changed["changed_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == changed["changed_text"]) & rows[place[host_column]].cast("string").eqNullSafe(changed["changed_host"])
    met = rows.join(changed.hint("merge"), same, "left").where(F.coalesce("changed_kept", F.lit(True)))
    lines = F.arrays_zip(F.split(text, "\n").alias("raw"), _norm_lines(place[text_column]).alias("norm"))
    stay = F.filter(lines, lambda z: (z["norm"] == "") | ~F.array_contains(F.col("changed_gone"), F.xxhash64(z["norm"])))
    lost = F.col("changed_gone").isNotNull()
    met = met.withColumn(place[text_column], F.when(lost, F.array_join(F.transform(stay, lambda z: z["raw"]), "\n")).otherwise(text))
    if length_column is not None:
        length = place[length_column]
        met = met.withColumn(length, F.when(lost, F.length(place[text_column]).cast(rows.schema[length].dataType)).otherwise(F.col(length)))
    return met.select(*[F.col(name).alias(c) for c, name in place.items()])
