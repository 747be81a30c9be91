"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source.  A token budget is divided top down: at each node the
children share it by weight, none gets more than its subtree can give (its tokens times
`max_epochs`), and what one child cannot use goes to its siblings by weight.  As a child's limit is
that of its whole subtree, a shortage is met by siblings first and by the ancestors' siblings only
when all of them are used up.  With children in order of limit per weight, the level that all
unlimited children share is the largest of (budget - limits before) / (weights from here on), so
one window per parent finds it.

A leaf's budget of b tokens takes whole epochs and then, of one more epoch, the prefix of the
leaf's documents, in that epoch's seeded order, that stays within what is left.  The order is that
of a 60-bit hash, so the prefix is a cut: sums over 4096 ranges of the hash find the range that
holds the cut, twice, and only the rows of that last range are put in order.  No leaf is ever
sorted whole.  Whether a row is in is then a function of the row and its leaf's cut: texts are not
shuffled.

Defined results.  A null text has no tokens; such rows come with their leaf's whole epochs and
below its cut.  A null language, source or domain is a branch of its own.  A branch without a
listed weight has the default weight; weight 0 takes nothing.  Rows that tie in the order, such as
repeated rows, are in or out together.  An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_PATTERN, drop_table, shared_table

LEVELS = ("domain", "language", "source")
ADDED = ("mix_domain", "mix_epoch", "mix_tokens", "mix_budget")
#: Bits of the hash that one level of the search takes.
BITS, STEP = 60, 12


class Targets(NamedTuple):
    """Weights by name at each level, the weight of other names, and the budget as a share of all tokens."""

    domain: dict[str, float]
    language: dict[str, float]
    source: dict[str, float]
    default: float = 1.0
    share: float = 0.6
    max_epochs: int = 2
    seed: int = 17


def _weight(name: Column, weights: dict[str, float], default: float) -> Column:
    found = F.lit(float(default))
    for key, weight in weights.items():
        found = F.when(name == key, F.lit(float(weight))).otherwise(found)
    return found


def order_hash(epoch: Column, row_id: Column, tokens: Column, seed: int) -> Column:
    """A row's place in an epoch: the first 60 bits of an MD5 of seed, epoch, id and size."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit("null")), tokens.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _fill(children: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """`children` (with limit and budget, the parent's) with `given`: their part of the budget."""
    children = children.withColumn("w", weight).withColumn("ratio", F.when(F.col("w") > 0, F.col("limit") / F.col("w")))
    order = Window.partitionBy(*parent).orderBy(F.asc_nulls_last("ratio"), *LEVELS)
    before = F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col("w") > 0, (F.col("budget") - F.coalesce(before, F.lit(0))) / onward)
    children = children.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    given = F.least(F.col("limit").cast("double"), F.col("w") * F.greatest(F.col("level"), F.lit(0.0)))
    return children.withColumn("given", F.coalesce(given, F.lit(0.0))).drop("w", "ratio", "level")


def leaf_budgets(rows: DataFrame, targets: Targets) -> DataFrame:
    """From rows (domain, language, source, tokens): a row per leaf with tokens and budget."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = shared_table(leaves.withColumn("limit", F.col("tokens") * targets.max_epochs).withColumn("root", F.lit(0)), "mix-leaves")
    total = leaves.groupBy("root").agg(F.sum("tokens").alias("all_tokens"))
    null = F.lit(None).cast("string")
    domains = leaves.groupBy("root", "domain").agg(F.sum("limit").alias("limit")).withColumns({"language": null, "source": null})
    domains = domains.join(total, "root").withColumn("budget", F.floor(F.col("all_tokens") * targets.share).cast("double"))
    domains = _fill(domains, ["root"], _weight(F.col("domain"), targets.domain, targets.default))
    languages = leaves.groupBy("domain", "language").agg(F.sum("limit").alias("limit")).withColumn("source", null)
    languages = _fill(_under(languages, domains, ["domain"]), ["domain"], _weight(F.col("language"), targets.language, targets.default))
    sources = _fill(_under(leaves, languages, ["domain", "language"]), ["domain", "language"], _weight(F.col("source"), targets.source, targets.default))
    return sources.select(*LEVELS, "tokens", F.floor(F.round("given", 6)).cast("long").alias("budget"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"of_{key}"])
    return condition


def _under(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    given = parents.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("given").alias("budget"))
    return children.join(given, _same(children, given, keys)).drop(*[f"of_{k}" for k in keys])


def _with_leaf(rows: DataFrame, leaves: DataFrame, columns: list[str]) -> DataFrame:
    leaf = leaves.select(*[F.col(k).alias(f"of_{k}") for k in LEVELS], *columns)
    return rows.join(leaf, _same(rows, leaf, list(LEVELS))).drop(*[f"of_{k}" for k in LEVELS])


def leaf_cuts(rows: DataFrame, targets: Targets) -> DataFrame:
    """From rows (id, domain, language, source, tokens): a row per leaf with its budget, the number
    of whole epochs, and the largest order hash of the next epoch that is in."""
    rows = shared_table(rows.select("id", *LEVELS, "tokens"), "mix-rows")
    leaves = leaf_budgets(rows, targets)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    leaves = leaves.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("head", F.lit(0).cast("long"))
    leaves = leaves_table = shared_table(leaves, "mix-budgets")
    hashed = lambda r: r.withColumn("hash", order_hash(F.col("epochs") + 1, F.col("id"), F.col("tokens"), targets.seed))
    up = Window.partitionBy(*LEVELS).orderBy("part")
    for shift in (BITS - STEP, BITS - 2 * STEP):
        open_rows = hashed(_with_leaf(rows, leaves, ["epochs", "rest", "head"])).where(F.shiftright("hash", shift + STEP) == F.col("head"))
        parts = open_rows.groupBy(*LEVELS, F.shiftright("hash", shift).alias("part"), "rest").agg(F.sum("tokens").alias("sum"))
        parts = parts.withColumn("before", F.sum("sum").over(up) - F.col("sum")).where(F.col("before") <= F.col("rest"))
        last = parts.groupBy(*LEVELS).agg(F.max_by(F.struct("part", "before"), "part").alias("at"))
        found = last.select(*[F.col(k).alias(f"of_{k}") for k in LEVELS], "at")
        leaves = leaves.join(found, _same(leaves, found, list(LEVELS)), "left").drop(*[f"of_{k}" for k in LEVELS])
        head = F.coalesce(F.col("at.part"), F.shiftleft("head", STEP))
        spent = leaves_table
        leaves = leaves_table = shared_table(leaves.select(*LEVELS, "tokens", "budget", "epochs", (F.col("rest") - F.coalesce("at.before", F.lit(0))).alias("rest"), head.alias("head")), "mix-search")
        drop_table(spent)
    shift = BITS - 2 * STEP
    near = hashed(_with_leaf(rows, leaves, ["epochs", "rest", "head"])).where(F.shiftright("hash", shift) == F.col("head"))
    near = near.groupBy(*LEVELS, F.col("hash").alias("part"), "rest").agg(F.sum("tokens").alias("sum"))
    inside = near.withColumn("upto", F.sum("sum").over(up)).where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("part").alias("cut"))
    inside = inside.select(*[F.col(k).alias(f"of_{k}") for k in LEVELS], "cut")
    cuts = leaves.join(inside, _same(leaves, inside, list(LEVELS)), "left").drop(*[f"of_{k}" for k in LEVELS])
    cuts = shared_table(cuts.select(*LEVELS, "budget", "epochs", F.coalesce("cut", F.shiftleft("head", shift) - 1).alias("cut")), "mix-cuts")
    drop_table(rows)
    drop_table(leaves)
    return cuts


def count_tokens(text: Column) -> Column:
    """Tokens for budgeting: the words of the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def mix(docs: DataFrame, domain: Column, targets: Targets, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", source_column: str = "source") -> DataFrame:
    """The chosen rows of `docs`, all columns, once per epoch they are in, with mix_domain, mix_epoch
    (from 1), mix_tokens and mix_budget, the budget of the leaf, which take the place of columns of
    `docs` with these names.  `domain` gives a row's domain."""
    # The row travels whole, so that no column of `docs` can clash with the names used here.
    named = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_column).alias("id"), domain.alias("domain"),
        F.col(language_column).cast("string").alias("language"), F.col(source_column).cast("string").alias("source"), count_tokens(F.col(text_column)).alias("tokens"),
    )
    cuts = leaf_cuts(named.drop("row"), targets)
    met = _with_leaf(named, cuts, ["budget", "epochs", "cut"])
    extra = (order_hash(F.col("epochs") + 1, F.col("id"), F.col("tokens"), targets.seed) <= F.col("cut")).cast("int")
    met = met.withColumn("times", F.col("epochs") + extra).where(F.col("times") > 0)
    kept = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c not in ADDED]
    return met.select(*kept, F.col("domain").alias("mix_domain"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("mix_epoch"), F.col("tokens").alias("mix_tokens"), F.col("budget").alias("mix_budget"))
