"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts over all training rows: each task adds up its rows in numpy and sends
one vector per language, Spark sums the vectors by bucket, and the driver receives languages x
buckets numbers, whatever the size of the input.  The log-probability matrix is broadcast; texts
are scored in numpy blocks of fixed size, so a very long text costs time, not memory.

Defined results.  A text that is null or has no letter is `und` with score 0.  A null language or
null text is not learnt from.  With nothing to learn from, every text is `und`.  Ties go to the
language that sorts first.  Repeated rows are scored each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ship_by_value

LENGTHS = (2, 3)
BUCKETS = 1 << 15
#: Characters handled at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Languages beyond this many are refused, not dropped: the matrix is broadcast.
MAX_LANGUAGES = 1000


class LanguageModel(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    #: languages x (LENGTHS x BUCKETS + 1); the last column, for places without an n-gram, is 0.
    weights: np.ndarray


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of n-gram buckets with the text each place belongs to.

    Every text stands between two blanks; places where an n-gram would leave its text have the
    bucket one past the last.
    """
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    codes = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if texts else np.zeros(0, np.uint32)
    none = BUCKETS * len(LENGTHS)
    for low in range(0, len(codes), BLOCK):
        high = min(len(codes), low + BLOCK)
        at = np.arange(low, high)
        owner = np.searchsorted(ends, at, side="right")
        room = ends[owner] - at
        for k, n in enumerate(LENGTHS):
            h = np.zeros(high - low, dtype=np.uint64)
            for j in range(n):
                c = codes[low + j : high + j].astype(np.uint64)
                h[: len(c)] = h[: len(c)] * np.uint64(0x100000001B3) + c
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            yield np.where(room >= n, (h % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS, none), owner


def train(docs: DataFrame, language_column: str = "lang", text_column: str = "text", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from every row with a text and a language.  More than `max_languages` languages are an error."""
    size = BUCKETS * len(LENGTHS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(language, []).append(text)
            for language, texts in by.items():
                total = sums.setdefault(language, np.zeros(size, dtype=np.int64))
                rows[language] = rows.get(language, 0) + len(texts)
                for buckets, _ in _pieces(texts):
                    total += np.bincount(buckets, minlength=size + 1)[:size]
        for language, total in sums.items():
            hit = np.flatnonzero(total)
            # The number of rows rides along as bucket -1.
            yield pa.RecordBatch.from_arrays(
                [pa.array([language]), pa.array([np.append(hit, -1).astype(np.int32)], pa.list_(pa.int32())), pa.array([np.append(total[hit], rows[language])], pa.list_(pa.int64()))],
                names=["language", "bucket", "n"],
            )

    rows = docs.select(F.col(language_column).alias("language"), F.lower(F.col(text_column)).alias("text")).dropna()
    parts = rows.mapInArrow(count, "language string, bucket array<int>, n array<bigint>")
    sums = parts.select("language", F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy("language", F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n"))
    found = sums.groupBy("language").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found.sort(key=lambda r: r["language"])
    counts = np.zeros((len(found), size + 1))
    for i, r in enumerate(found):
        counts[i, np.array(r["bucket"])] = r["n"]  # bucket -1 is the last column
    rows_of, counts = counts[:, -1].copy(), counts[:, :-1]
    parts_of = counts.reshape(len(found), len(LENGTHS), BUCKETS)
    logs = np.log((parts_of + 0.5) / (parts_of.sum(axis=2, keepdims=True) + 0.5 * BUCKETS)).reshape(len(found), size)
    prior = np.log(rows_of / rows_of.sum()) if len(found) else np.zeros(0)
    return LanguageModel([r["language"] for r in found], prior, np.hstack([logs, np.zeros((len(found), 1))]).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score.

    The prediction is the language of the largest posterior.  N-grams of a text are far from
    independent, so the posterior itself is 1 for nearly every text; the score is that of one average
    n-gram, the posterior's logarithms divided by the number of n-grams: it is largest for the
    prediction, and near one over the number of languages for a text that speaks for none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))  # a plain tuple: workers need not know its class

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, weights = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, grams = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
            named = np.array(batch.column(2).to_pylist(), dtype=bool) if len(texts) else np.zeros(0, bool)
            if len(languages):
                for buckets, owner in _pieces(texts):
                    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                    grams[owner[cuts]] += np.add.reduceat((buckets < BUCKETS * len(LENGTHS)).astype(float), cuts)
                    for k in range(len(languages)):
                        sums[owner[cuts], k] += np.add.reduceat(weights[k][buckets].astype(float), cuts)
                best = (sums + prior).argmax(axis=1)
                even = (sums + prior) / np.maximum(grams, 1.0)[:, None]
                top = 1.0 / np.exp(np.minimum(even - even[np.arange(len(texts)), best][:, None], 700.0)).sum(axis=1)
            else:
                best, top, named = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            said = [languages[b] if y else UNKNOWN for b, y in zip(best, named)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(np.where(named, top, 0.0))], names=["id", "lang_pred", "score"])

    kind = docs.select(F.col(id_column).alias("id")).schema["id"].dataType.simpleString()
    text = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("named"))
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


ship_by_value(__name__)
