"""Ranked retrieval: channels, reciprocal rank fusion, re-rank, fusion of several queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scores import RRF_K

#: Numbers of all queries together that are sent to every task.
MOST_NUMBERS = 1 << 22
#: Scores that a task holds at a time.
MOST_SCORES = 1 << 20
#: Query terms that are sent to every task.
MOST_TERMS = 1 << 17


def channel(rows: DataFrame, name: str, order: list[Column], n: int, query: str | None = None, item: str = "id") -> DataFrame:
    """The first n rows in order, numbered: (query,) id, channel, rank.

    With a query column each query has its own list; without, one bounded list is cut first, so the
    numbering never sees more than n rows.
    """
    keys = [query] if query else []
    if not query:
        rows = rows.orderBy(*order).limit(n)
    window = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return ranked.select(*keys, F.col(item).alias("id"), F.lit(name).alias("channel"), "rank")


def fuse(channels: list[DataFrame], weights: dict[str, float], query: str | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: (query,) id, rrf (6 places), channels, exact_rank.

    Lists may share a channel's name: their parts add up; the number of channels counts names.
    """
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("channel") == name, F.lit(w)).otherwise(weight)
    keys = [query] if query else []
    return rows.groupBy(*keys, "id").agg(
        F.round(F.sum(weight / (F.lit(k) + F.col("rank"))), 6).alias("rrf"), F.countDistinct("channel").cast("int").alias("channels"), F.min(F.when(F.col("channel") == "exact", F.col("rank"))).alias("exact_rank")
    )


def rerank(hits: DataFrame, policy: Column, query: str) -> DataFrame:
    """Blend of policy score and fused rank: `hits` with final (4 places)."""
    top = F.max("rrf").over(Window.partitionBy(query))
    fused = F.least(F.lit(1.0), F.when(top > 0, F.col("rrf") / top).otherwise(0.0) + 0.04 * F.greatest(F.lit(0), F.col("channels") - 1))
    final = 0.52 * policy + 0.48 * fused
    final = F.when(F.col("exact_rank").isNotNull(), F.greatest(final, 0.98 - 0.005 * F.greatest(F.lit(0), F.col("exact_rank") - 1))).otherwise(final)
    return hits.withColumn("final", F.round(F.least(F.lit(1.0), final), 4))


def _multiplier(sent, k: int, most_scores: int = MOST_SCORES):
    """The task side of `cosine_topk`: of batches of vectors what may be among the k best of each query sent
    (ids, vectors of length 1); no more than `most_scores` scores, or one query's, are held at a time."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = sent.value
        for batch in batches:
            own, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            if not len(own) or not len(ids):
                continue
            if set(np.diff(column.offsets.to_numpy())) != {unit.shape[1]}:
                raise ValueError("vectors of different lengths")
            block = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), unit.shape[1])
            norm = np.sqrt((block * block).sum(axis=1))
            block = np.divide(block, norm[:, None], out=np.zeros_like(block), where=norm[:, None] > 0)
            step = max(1, most_scores // len(own))
            for start in range(0, len(ids), step):
                part = ids[start : start + step]
                scores = (block @ unit[start : start + step].T).T
                scores[part[:, None] == own] = -np.inf
                # Scores are rounded later: what may round to the k-th best stays.
                floor = np.partition(scores, max(scores.shape[1] - k, 0), axis=1)[:, max(scores.shape[1] - k, 0)] - 1e-6 if scores.shape[1] > k else np.full(len(part), -np.inf)
                q, v = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(part[q]), pa.array(own[v]), pa.array(scores[q, v])], names=["query_id", "id", "score"])

    return multiply


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, at_least: float = -1.0, most_numbers: int = MOST_NUMBERS) -> DataFrame:
    """The k most similar vectors of each query but itself: query_id, id, score, rank.

    `queries` and `vectors` have id and embedding; vectors of another length are an error, and one
    without length scores 0.  Null vectors, and vectors with a null number, are left out on both sides.
    Queries of up to `most_numbers` numbers are counted first, then sent to all tasks, which multiply
    them with blocks of vectors, some queries at a time, and keep the best of each block; more queries go in blocks of that size.
    """
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    queries, vectors = queries.where(whole), vectors.where(whole)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    held, longest = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if held > most_numbers:
        # Blocks of queries by hash; each block is sent and multiplied by itself.
        blocks = -(-2 * held // max(most_numbers, longest))
        parts = [cosine_topk(queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), vectors, k, at_least, max(held, 1)) for i in range(blocks)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found
    asked = queries.select("id", "embedding").toPandas().sort_values("id")
    if asked.empty:
        scored = vectors.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    else:
        matrix = np.array(asked["embedding"].to_list(), dtype=float).reshape(len(asked), -1)
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        unit = np.divide(matrix, lengths[:, None], out=np.zeros_like(matrix), where=lengths[:, None] > 0)
        sent = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), unit))
        multiply = _multiplier(sent, k)
        kind = vectors.schema["id"].dataType.simpleString()
        scored = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(multiply, f"query_id {kind}, id {kind}, score double")
    scored = scored.withColumn("score", F.round("score", 6)).where(F.col("score") >= at_least)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def term_overlap_topk(queries: DataFrame, documents: DataFrame, k: int, at_least: float) -> DataFrame:
    """Documents by the share of a query's terms that they have: query_id, id, overlap, rank.

    `queries` and `documents` have id and terms (distinct).  The texts are read once: of a document only
    the terms that some query has are kept (up to MOST_TERMS query terms are sent to all tasks, more meet
    in a join).  A document with enough of a query's n terms has one of its n - need + 1 rarest, so pairs
    come from those alone; common terms are only counted for the pairs that a rarer one made.
    """
    # Query terms by number: pairs compare small arrays of integers.
    asked = queries.select(F.explode("terms").alias("term")).distinct().withColumn("code", F.row_number().over(Window.orderBy("term"))).persist()
    sent = F.broadcast(asked) if asked.count() <= MOST_TERMS else asked
    coded = queries.select(F.col("id").alias("query_id"), F.explode("terms").alias("term")).join(sent, "term").groupBy("query_id").agg(F.collect_list("code").alias("codes")).persist()
    # The outer form adds no test of the terms' number below, which would work them out twice.
    held = documents.select("id", F.explode_outer("terms").alias("term")).join(sent, "term").groupBy("id").agg(F.collect_list("code").alias("known")).persist()
    d = held.select("id", F.explode("known").alias("code"))
    counts = d.groupBy("code").agg(F.count(F.lit(1)).alias("n_documents"))
    q = coded.select("query_id", F.size("codes").alias("n_terms"), F.explode("codes").alias("code")).join(counts, "code")
    # Terms that no document has would come first in the order.
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy("n_documents", "code")) + F.col("n_terms") - F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(at_least) * F.col("n_terms") - 1e-9))
    q = q.withColumn("place", rarest).where(F.col("place") <= F.col("n_terms") - need + 1).select("query_id", "code")
    # Pairs of a document are made where its terms lie; they are distinct before anything is joined back.
    met = d.join(q, "code").select("id", "query_id").distinct()
    pairs = met.join(held, "id").join(coded, "query_id")
    hits = pairs.select("query_id", "id", F.round(F.size(F.array_intersect("known", "codes")) / F.size("codes"), 6).alias("overlap")).where(F.col("overlap") >= at_least)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "id"))).where(F.col("rank") <= k)


def fuse_queries(hits: DataFrame, n: int) -> DataFrame:
    """Fusion of several lists of one question: question, id, score (4 places), appearances.

    `hits` has question, part (0 is the question itself), id, score and rank.
    """
    weight = F.when(F.col("part") == 0, 1.0).otherwise(0.92)
    found = hits.groupBy("question", "id").agg(F.max(weight * (0.70 * F.col("score") + 0.30 / F.col("rank"))).alias("best"), F.count(F.lit(1)).alias("appearances"))
    found = found.withColumn("score", F.round(F.col("best") + F.least(F.lit(0.12), 0.03 * (F.col("appearances") - 1)), 4)).drop("best")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)


def low_quality(hits: DataFrame, query: str = "query_id", score: str = "score") -> DataFrame:
    """Per query whether its list is weak: a low best score, or a middling one without a lead."""
    two = hits.groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"))
    weak = F.col("top").isNull() | (F.col("top") < 0.58) | (F.col("second").isNotNull() & (F.col("top") < 0.75) & (F.col("top") - F.col("second") < 0.04))
    return two.select(query, "top", weak.alias("low_quality"))


def answer_decision(hits: DataFrame) -> DataFrame:
    """Per query the kind of answer its evidence allows, by the first rule that holds.

    `hits` has query_id, allowed, active, pending, polarity, identity, task_status and score.
    """
    seen = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"), F.count_if(F.col("allowed") & F.col("active")).alias("n_active"), F.count_if(F.col("allowed") & F.col("pending")).alias("n_pending"),
        F.countDistinct(F.when(F.col("allowed"), F.col("polarity"))).alias("polarities"), F.countDistinct(F.when(F.col("allowed"), F.col("identity"))).alias("identities"),
        F.count_if(F.col("allowed") & F.col("task_status").isNotNull()).alias("tasks"), F.max(F.when(F.col("allowed"), F.col("score"))).alias("top"),
    )
    kind = (
        F.when((F.col("n") > 0) & (F.col("n_allowed") == 0), "restricted").when(F.col("n_allowed") == 0, "no_answer").when(F.col("n_active") == 0, "history")
        .when((F.col("n_pending") > 0) | (F.col("polarities") > 1), "conflict").when((F.col("identities") >= 2) & (F.col("tasks") >= 2), "clarification").when(F.col("top") < 0.58, "qualified").otherwise("answered")
    )
    return seen.select("query_id", "n", "n_allowed", kind.alias("answer_type"))
