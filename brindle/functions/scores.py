"""Scores and order statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of retrieval channels in reciprocal rank fusion, for memories and for notes.
MEMORY_CHANNELS = {"exact": 1.60, "structured": 1.35, "family": 1.20, "fts": 1.00, "vector": 0.95, "trigram": 0.60}
NOTE_CHANNELS = {"exact": 1.55, "fts": 1.00, "vector": 0.95, "lexical": 0.85, "trigram": 0.60}
# The constant of reciprocal ranks, and the weights of the policy score: topic, intent,
# importance, recency, confidence, accesses.
RRF_K = 60
POLICY_WEIGHTS = (0.72, 0.08, 0.07, 0.05, 0.05, 0.03)


def age_days(ts: Column, asof: Column) -> Column:
    """Days from `ts` to `asof`, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(asof) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))


def recency(ts: Column, asof: Column) -> Column:
    """1 within a week, then falling over a year to 0.1; 0 for null."""
    age = age_days(ts, asof)
    return F.when(ts.isNull(), 0.0).when(age <= 7, 1.0).when(age >= 365, 0.1).otherwise(F.greatest(F.lit(0.1), 1 - age / 365))


def episodic_recency(ts: Column, asof: Column) -> Column:
    return F.greatest(F.lit(0.15), 1 - F.least(age_days(ts, asof), F.lit(365.0)) / 365)


def policy_score(topic: Column, intent: Column, importance: Column, recent: Column, confidence: Column, accesses: Column, factor: Column) -> Column:
    """The weighted policy score, times a status factor, to 4 places; 0 without topic and intent."""
    parts = (topic, intent, importance, recent, confidence, F.least(accesses / 10, F.lit(1.0)))
    final = sum((w * p for w, p in zip(POLICY_WEIGHTS[1:], parts[1:])), POLICY_WEIGHTS[0] * parts[0])
    return F.when((topic <= 0) & (intent <= 0), 0.0).otherwise(F.round(final * factor, 4))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length, an error where their lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(dot(a, b))
    return F.when(norms == 0, 0.0).otherwise(checked / norms)


def ranges(rows: DataFrame, value: str, n: int = 64) -> Column:
    """The number of the range of a value's column that a row falls into, 0 to `n`; the bounds are
    approximate quantiles, so that ranges hold about as many rows each."""
    cuts = sorted(set(rows.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.002)))
    x = F.col(value).cast("double")
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= x))


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], method: str | dict[str, str]) -> DataFrame:
    """Per group, an exact element of the sorted values for each share; nulls are left out.

    `nearest` takes index round((n-1)q), halves to even; `floor` and `ceil` take the index below and above.  Equal
    values are counted before the shuffle.  The counts of ranges of values tell in which range an
    element lies; only there are the values gone through, so no task sees a whole group.
    """
    rows = rows.where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_value")).withColumn("range", ranges(rows, value))
    parts = counts.groupBy(*keys, "range").agg(F.sum("n_value").alias("n_range"))
    up = Window.partitionBy(*keys).orderBy("range")
    parts = parts.withColumns({"before": F.sum("n_range").over(up) - F.col("n_range"), "n": F.sum("n_range").over(Window.partitionBy(*keys))})
    names = []
    for name, q in shares.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        index = {"nearest": F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(at, 0).cast("long"))), "floor": F.floor(at), "ceil": F.ceil(at)}[method if isinstance(method, str) else method[name]]
        names.append(F.struct(F.lit(name).alias("name"), index.cast("long").alias("index")))
    wanted = parts.select("*", F.explode(F.array(*names)).alias("w")).where((F.col("before") <= F.col("w.index")) & (F.col("w.index") < F.col("before") + F.col("n_range")))
    wanted = wanted.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("range").alias("_range"), F.col("before").alias("_before"), F.col("n").alias("_n"), F.col("w.name").alias("_name"), F.col("w.index").alias("_index"))
    same = F.col("range") == F.col("_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    upto = F.col("_before") + F.sum("n_value").over(Window.partitionBy(*keys, "_name").orderBy(value))
    found = counts.join(wanted, same).withColumn("_upto", upto).where(F.col("_upto") > F.col("_index"))
    return found.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares])


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group, linearly interpolated exact percentiles, from the elements below and above; nulls are left out."""
    both = {f"{name}|{way}": q for name, q in shares.items() for way in ("floor", "ceil")}
    found = order_statistics(rows, keys, value, both, {name: name.rsplit("|", 1)[1] for name in both})

    def between(name: str, q: float) -> Column:
        low, high, at = F.col(f"`{name}|floor`").cast("double"), F.col(f"`{name}|ceil`").cast("double"), (F.col("n") - 1) * F.lit(float(q))
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select(*keys, "n", *[between(name, q) for name, q in shares.items()])
