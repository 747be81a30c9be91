"""Operational metrics and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient to 6 places; 0 where the divisor is 0."""
    return F.when(bottom == 0, 0.0).otherwise(F.round(top / bottom, 6))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn."""
    found = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return found.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def conservation(statuses: DataFrame, status: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row: submitted, a count per named group of statuses, and what is unaccounted for."""
    counts = [F.count_if(F.col(status).isin(values)).alias(name) for name, values in groups.items()]
    row = statuses.agg(F.count(F.lit(1)).alias("submitted"), *counts)
    total = sum((F.col(n) for n in groups), F.lit(0))
    return row.withColumn("conservation_delta", F.col("submitted") - total)


def multiset_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of two multisets of keys."""
    g = gold.groupBy(key).agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy(key).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, key, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    return with_scores(both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn")))


def binary_scores(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    return with_scores(rows.agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn")))


def confusion(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """Counts of gold by predicted label; labels that are not listed count as `other`."""
    fixed = lambda c: F.when(F.col(c).isin(labels), F.col(c)).otherwise("other")
    pairs = rows.select(fixed(gold).alias("gold"), fixed(predicted).alias("predicted"))
    return pairs.groupBy("gold").pivot("predicted", [*labels, "other"]).count().na.fill(0)


def per_label_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One-versus-rest scores per label, from one count per (gold, predicted)."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("g") == F.col("p")
    sides = F.when(hit, F.array(F.struct(F.col("g").alias("label"), F.lit("tp").alias("kind")))).otherwise(F.array(F.struct(F.col("g").alias("label"), F.lit("fn").alias("kind")), F.struct(F.col("p").alias("label"), F.lit("fp").alias("kind"))))
    counted = pairs.select("n", F.explode(sides).alias("s")).groupBy("s.label")
    return with_scores(counted.agg(*[F.sum(F.when(F.col("s.kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")]))


def retrieval_scores(hits: DataFrame, relevant: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per query precision, recall and hit at each cutoff, reciprocal rank and nDCG@10.

    `hits` has query_id, id, rank; `relevant` has query_id, id, gain.  Recall is null without
    relevant items.
    """
    gains = relevant.withColumn("ideal_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")))
    ideal = gains.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("ideal_rank") <= 10, F.col("gain") / F.log2(F.col("ideal_rank") + 1))).alias("ideal"))
    return _scored(hits.join(relevant.select("query_id", "id", "gain"), ["query_id", "id"], "left"), ideal, cutoffs)


def class_retrieval_scores(hits: DataFrame, totals: DataFrame, cutoffs: list[int]) -> DataFrame:
    """The same where all relevant items count 1 and are too many to be listed: `hits` has query_id, rank
    and relevant (boolean), `totals` query_id and n_relevant."""
    upto = F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int"))
    ideal = totals.withColumn("ideal", F.when(F.col("n_relevant") > 0, F.aggregate(upto, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))))
    return _scored(hits.withColumn("gain", F.when(F.col("relevant"), 1.0)), ideal.where("n_relevant > 0"), cutoffs)


def _scored(found: DataFrame, ideal: DataFrame, cutoffs: list[int]) -> DataFrame:
    got = found.groupBy("query_id").agg(
        *[F.count_if(F.col("gain").isNotNull() & (F.col("rank") <= k)).alias(f"hits_{k}") for k in cutoffs],
        F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first_rank"), F.sum(F.when(F.col("rank") <= 10, F.col("gain") / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    row = got.join(ideal, "query_id", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    per_k = [c for k in cutoffs for c in (F.round(F.col(f"hits_{k}") / k, 6).alias(f"precision_{k}"), F.when(n > 0, F.round(F.col(f"hits_{k}") / n, 6)).alias(f"recall_{k}"), (F.col(f"hits_{k}") > 0).cast("int").alias(f"hit_{k}"))]
    return row.select("query_id", *per_k, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg_10"))


def durations(rows: DataFrame, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Milliseconds between two times for each named span, at least 0; null where one is missing."""
    ms = lambda a, b: F.greatest(F.unix_millis(b) - F.unix_millis(a), F.lit(0))
    return rows.select("*", *[ms(a, b).alias(name) for name, (a, b) in spans.items()])


def percentile_columns(rows: DataFrame, values: list[str], shares: dict[str, float]) -> DataFrame:
    """One row: for each value and share its nearest-rank percentile, `share_value`; all values in one pass."""
    from brindle.functions.scores import order_statistics

    long = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select("x.name", "x.value")
    found = order_statistics(long, ["name"], "value", shares, "nearest")
    return found.agg(*[F.max(F.when(F.col("name") == v, F.col(s))).alias(f"{s}_{v}") for v in values for s in shares])


def submission_report(tasks: DataFrame, status: str, accepted: DataFrame, submission: dict[str, int]) -> DataFrame:
    """One row that accounts for every submitted request, and what it leaves unaccounted for.

    Requests that a client saw fail but that were accepted count once, as accepted.
    """
    n = lambda *names: F.count_if(F.col(status).isin(*names))
    row = tasks.agg(n("completed").alias("completed"), n("blocked", "queued", "running", "retry").alias("pending"), n("cancelled").alias("cancelled"), n("dead_letter").alias("dead_letter"))
    row = row.crossJoin(accepted.agg(F.count(F.lit(1)).alias("accepted")))
    of = lambda name: F.lit(int(submission.get(name) or 0)).cast("long")
    confirmed = of("accepted") if "accepted" in submission else F.col("accepted")
    late = F.least(of("failed"), F.greatest(F.lit(0).cast("long"), F.col("accepted") - confirmed))
    row = row.withColumns({"duplicate": of("duplicate"), "rate_limited": of("rate_limited"), "unaccepted": F.greatest(F.lit(0).cast("long"), of("failed") - late)})
    submitted = of("submitted") if submission.get("submitted") else F.col("accepted") + of("duplicate") + of("rate_limited") + of("failed")
    row = row.withColumns({"submitted": submitted, "failed": F.col("cancelled") + F.col("dead_letter") + F.col("unaccepted")})
    total = F.col("completed") + F.col("failed") + F.col("pending") + F.col("rate_limited") + F.col("duplicate")
    return row.withColumns({"failure_rate": F.when(F.col("submitted") > 0, F.round(F.col("failed") / F.col("submitted"), 6)), "conservation_delta": F.col("submitted") - total})


def retry_reconciliation(attempts: DataFrame, accepted: int) -> DataFrame:
    """One row from the reports of an initial submission and its retries, in order, against what was
    accepted: accepted, duplicate, rate_limited, failed, retry_attempts.

    `attempts` has attempt (0 is the first), submitted, accepted, duplicate, rate_limited and failed.
    """
    row = attempts.agg(
        F.max_by("submitted", -F.col("attempt")).alias("submitted"), F.max_by("duplicate", -F.col("attempt")).alias("first_duplicate"), F.max_by("rate_limited", "attempt").alias("rate_limited"),
        F.max_by("failed", "attempt").alias("last_failed"), F.sum("accepted").alias("said"), (F.count(F.lit(1)) - 1).alias("retry_attempts"),
    )
    held, zero = F.lit(accepted).cast("long"), F.lit(0).cast("long")
    row = row.withColumns({"duplicate": F.greatest(F.col("first_duplicate"), F.col("submitted") - held - F.col("rate_limited") - F.col("last_failed")), "accepted": F.least(held, F.col("said"))})
    open_ = F.greatest(zero, F.col("submitted") - held - F.col("duplicate") - F.col("rate_limited"))
    return row.select("submitted", "accepted", "duplicate", "rate_limited", (F.greatest(zero, held - F.col("accepted")) + open_).alias("failed"), "retry_attempts")


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 of per-label scores, in one row."""
    return scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def by_dataset(cases: DataFrame, values: list[str]) -> DataFrame:
    """Per dataset the number of cases and the mean of each value, nulls left out, to 6 places."""
    return cases.groupBy("dataset").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(v), 6).alias(v) for v in values])
