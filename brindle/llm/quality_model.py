"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are the hashed words of its whole text (log counts, unit length) and some
standardised numbers: character classes, line and word shape, sizes.  The machine adds to a linear
score the products of all feature pairs through K latent factors, in linear time:

    1/2 * sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2)

It is fitted in the driver on a bounded sample of labelled rows (`max_rows`, the rows of smallest
hash), shipped to the executors as two small arrays and applied in numpy to blocks of texts.

Defined results.  Null and empty texts get the score of a text without words.  Rows without a
label are scored but not learnt from.  With no labelled row at all, every score is 0.5.  Repeated
rows are scored each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ship_by_value
from brindle.llm.hashing import word_hashes, word_spans

BUCKETS = 1 << 14
FACTORS = 8
#: Bytes of text handled at a time; a longer text is a block of its own.
BLOCK = 1 << 22
#: At most this many labelled rows are fitted.
MAX_ROWS = 8000

# Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 symbol, 7 mark, 8 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in "#*$%&|<>@_^~{}[]=+\\/"]] = 6
_CLASS[[ord(c) for c in "!?.,;:-'\"()"]] = 7
N_CLASSES = 9
N_DENSE = N_CLASSES + 8


class Machine(NamedTuple):
    bias: float
    #: BUCKETS + N_DENSE linear weights and as many rows of FACTORS factors.
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield at, to
        at = to


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of `values`; run i is first[i] up to first[i + 1]."""
    run = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=float)])
    return run[first[1:]] - run[first[:-1]]


def _features(column: pa.Array, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts as sparse rows: bucket, value, first place of each row, numbers of each row."""
    column = column.cast(pa.large_string())
    raw, offsets = text_bytes_as_is(column)
    for low, high in _blocks(offsets):
        body, ends = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        n = high - low
        folded = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
        starts, stops, first = word_spans(folded, ends)
        hashes = word_hashes(folded, starts, stops)
        owner = np.repeat(np.arange(n), np.diff(first))
        keys, counts = np.unique((owner.astype(np.uint64) << np.uint64(20)) | (hashes & np.uint64(BUCKETS - 1)), return_counts=True)
        row = (keys >> np.uint64(20)).astype(np.int64)
        cut = np.searchsorted(row, np.arange(n + 1))
        value = np.log1p(counts.astype(float))
        norm = np.sqrt(np.maximum(_sums(value * value, cut), 1e-12))
        bucket = (keys & np.uint64((1 << 20) - 1)).astype(np.int32)
        dense = np.zeros((n, N_DENSE))
        kinds = _CLASS[body]
        length = np.maximum(np.diff(ends), 1)
        for k in range(N_CLASSES):
            places = np.searchsorted(np.flatnonzero(kinds == k), ends)
            dense[:, k] = np.diff(places) / length
        words = np.diff(first)
        n_lines = np.diff(np.searchsorted(np.flatnonzero(kinds == 5), ends)) + 1
        span = _sums((stops - starts).astype(float), first)
        last = folded[stops - 1] if len(stops) else np.zeros(0, np.uint8)
        dense[:, N_CLASSES:] = np.stack([
            np.log1p(words), np.log1p(length), span / np.maximum(words, 1), np.diff(cut) / np.maximum(words, 1),
            np.log1p(words / n_lines), _sums((_CLASS[last] >= 6).astype(float) * (_CLASS[last] <= 7), first) / np.maximum(words, 1),
            _sums(((stops - starts) > 14).astype(float), first) / np.maximum(words, 1), np.log1p(np.maximum(np.nan_to_num(sizes[low:high]), 0)),
        ], axis=1)
        yield bucket, value / np.repeat(norm, np.diff(cut)), cut, dense


def text_bytes_as_is(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, case kept, and the offsets of its texts."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def _raw_scores(model: Machine, bucket: np.ndarray, value: np.ndarray, cut: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's score of each row, and its factor sums."""
    linear = _sums(model.weights[bucket] * value, cut) + numbers @ model.weights[BUCKETS:]
    terms = model.factors[bucket] * value[:, None]
    dense = numbers[:, :, None] * model.factors[BUCKETS:]
    total = _sums(terms, cut) + dense.sum(axis=1)
    square = _sums(terms * terms, cut) + (dense * dense).sum(axis=1)
    return model.bias + linear + 0.5 * (total * total - square).sum(axis=1), total


def _scaled(model: Machine, dense: np.ndarray) -> np.ndarray:
    return np.clip((dense - model.mean) / model.spread, -4, 4) * 0.25


def fit(labelled: DataFrame, gain: float = 0.002, epochs: int = 150, seed: int = 7) -> Machine:
    """Fit on `labelled` (text, size, label), a bounded number of rows; see `labelled_sample`.

    The sample is gone over until that lowers its mean loss by less than `gain`, `epochs` times at most.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, at = np.array(batch.column(2).to_pylist(), dtype=float), 0
            for bucket, value, cut, dense in _features(batch.column(0), np.array(batch.column(1).to_pylist(), dtype=float)):
                n = len(dense)
                yield pa.RecordBatch.from_arrays([
                    pa.array(labels[at : at + n]), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(bucket)),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value)), pa.array(list(dense), pa.list_(pa.float64())),
                ], names=["label", "bucket", "value", "dense"])
                at += n

    got = labelled.select("text", "size", "label").mapInArrow(rows, "label double, bucket array<int>, value array<double>, dense array<double>").toArrow().combine_chunks()
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(BUCKETS + N_DENSE), rng.normal(0, 0.01, (BUCKETS + N_DENSE, FACTORS))
    if len(got) == 0:
        return Machine(0.0, weights, np.zeros_like(factors), np.zeros(N_DENSE), np.ones(N_DENSE))
    labels = got["label"].to_numpy()
    dense = np.stack(got["dense"].to_pylist())
    order = np.lexsort((dense[:, 0], dense[:, N_CLASSES + 1], labels))  # the same order however tasks ended
    lists = [(np.array(b, dtype=np.int64), np.array(v)) for b, v in zip(got["bucket"].to_pylist(), got["value"].to_pylist())]
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    model = Machine(float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))), weights, factors, mean, spread)
    numbers = _scaled(model, dense)
    bias, rate, decay = model.bias, 0.1, 1e-5
    seen_w, seen_f, seen_b = np.full(len(weights), 1e-3), np.full(factors.shape, 1e-3), 1e-3
    before = np.inf
    for _ in range(epochs):
        rng.shuffle(order)
        loss = 0.0
        for low in range(0, len(order), 64):
            pick = order[low : low + 64]
            bucket, value = np.concatenate([lists[i][0] for i in pick]), np.concatenate([lists[i][1] for i in pick])
            cut = np.concatenate([[0], np.cumsum([len(lists[i][0]) for i in pick])])
            raw, total = _raw_scores(model._replace(bias=bias), bucket, value, cut, numbers[pick])
            loss += float(np.logaddexp(0, np.where(labels[pick] > 0.5, -raw, raw)).sum())
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            per = np.repeat(np.arange(len(pick)), np.diff(cut))
            places = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + N_DENSE), len(pick))])
            x = np.concatenate([value, numbers[pick].ravel()])
            per = np.concatenate([per, np.repeat(np.arange(len(pick)), N_DENSE)])
            hit, inverse = np.unique(places, return_inverse=True)
            g = slope[per] * x
            grad_w = np.bincount(inverse, g, len(hit)) + decay * weights[hit]
            grad_f = np.stack([np.bincount(inverse, g * (total[per, f] - factors[places, f] * x), len(hit)) for f in range(FACTORS)], axis=1) + decay * factors[hit]
            seen_w[hit] += grad_w**2
            seen_f[hit] += grad_f**2
            seen_b += slope.sum() ** 2
            weights[hit] -= rate * grad_w / np.sqrt(seen_w[hit])
            factors[hit] -= rate * grad_f / np.sqrt(seen_f[hit])
            bias -= rate * slope.sum() / np.sqrt(seen_b)
        if before - loss / len(order) < gain:
            break
        before = loss / len(order)
    return model._replace(bias=float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", text_column: str = "text", size_column: str = "n_chars", max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, size, label) of at most `max_rows` labelled ids: those with the smallest hash.

    The picked labels are bounded by `max_rows`, so they are broadcast and the texts stay in place.
    Of several labels or rows of one id the first counts, so no more than `max_rows` rows come out.
    """
    picked = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("double").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), F.col(f"`{size_column}`").cast("double").alias("size"))
    met = rows.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("text", "size", "label")).alias("row"))
    return met.select("row.text", "row.size", "row.label")


def score(docs: DataFrame, model: Machine, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """One row per row of `docs`: id, score (the probability of a good label)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple: workers need not know its class

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            at = 0
            for bucket, value, cut, dense in _features(batch.column(1), np.array(batch.column(2).to_pylist(), dtype=float)):
                raw, _ = _raw_scores(machine, bucket, value, cut, _scaled(machine, dense))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(dense)), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=["id", "score"])
                at += len(dense)

    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.col(size_column).cast("double").alias("size"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(rows, f"id {kind}, score double").withColumnRenamed("id", id_column)


ship_by_value(__name__)
