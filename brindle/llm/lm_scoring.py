"""LM scoring: a hidden Markov language model trained by Baum-Welch, scored by the forward recursion.

Words are known by a 64-bit hash.  Their counts over all training texts are summed by Spark and
stay distributed.  The HEAD most frequent words are symbols of the hidden Markov model; every other
word has the symbol of its bucket, BUCKETS by hash, with an emission of its own in each state, and
within a bucket a word has its smoothed share of the counts; the end of a text is a symbol too.  So
the model gives a proper probability to every text over the known words and one unseen word of each
bucket, and its parameters, states x (HEAD + BUCKETS + 1) numbers, are bounded and broadcast.

Texts are encoded once into a table in the shared folder.  A Baum-Welch round is one pass over all
training rows: each task runs the scaled forward-backward recursion over its rows, many at a time,
and emits expected counts, which Spark sums across partitions by (state, symbol).  The first
parameters come from a few rounds over a bounded sample, the SAMPLE pieces of at most PIECE words
of smallest hash among all pieces of all training texts; the final ones come from rounds over
everything.  Scoring is the scaled forward recursion over whole texts, exact up to
floating point; the shares of rarer words come from a join with the distributed counts.

Defined results.  A null text is empty and consists of its end.  With nothing to train on, N and V
are 0 and every base probability is 1.  In training, a text of over SEGMENT words is taken as several
sequences, to bound memory; scores are never cut.  Repeated rows count and are scored each.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import shared_table, ship_by_value
from brindle.llm.hashing import mix, text_bytes, word_hashes, word_spans

HEAD, BUCKETS = 1 << 16, 1 << 14
STATES = 8
ROUNDS = 2
SAMPLE, PIECE, STARTS, START_ROUNDS, SAMPLE_ROUNDS = 600, 4096, 6, 4, 10
#: Bytes of text, and words, handled at a time; words of one sequence in training.
BLOCK, WORDS, SEGMENT = 1 << 21, 1 << 19, 1 << 18
#: Words that a task of a Baum-Welch round has at least, so that the counts it emits stay small beside them.
TASK_WORDS = 1_500_000
#: Weight of the overall word distribution in each state's emissions.
PRIOR = 200.0


class Vocabulary(NamedTuple):
    head: np.ndarray  # hashes in order
    counts: np.ndarray  # training counts of the head, of each bucket of other words, of the end
    rest: np.ndarray  # words of each bucket of other words, and 1 for the unseen one; 0 for all other symbols
    n_tokens: int
    n_types: int


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def _text_blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield at, to
        at = to


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of all words of the one column of `texts`; blocks are combined before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for low, high in _text_blocks(offsets):
                body, ends = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, stops, _ = word_spans(body, ends)
                keys, n = np.unique(word_hashes(body, starts, stops).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return texts.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The bounded part of the counts: the HEAD most frequent words, the sums of the others by bucket, the totals."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("types")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(HEAD).toPandas()
    order = np.argsort(top["hash"].to_numpy(dtype=np.int64))
    head, n = top["hash"].to_numpy(dtype=np.int64)[order], top["n"].to_numpy(dtype=np.int64)[order]
    known = counts.sparkSession.createDataFrame(top[["hash"]].astype("int64"), "hash bigint")
    others = counts.join(F.broadcast(known), "hash", "left_anti").groupBy(F.pmod("hash", F.lit(BUCKETS)).alias("bucket"))
    others = others.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toPandas()
    tokens, types = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = others["bucket"].to_numpy(dtype=np.int64)
    tokens[at], types[at] = others["n"].to_numpy(dtype=np.int64), others["types"].to_numpy(dtype=np.int64)
    symbols = np.concatenate([n, tokens, [n_texts]]).astype(np.int64)
    rest = np.concatenate([np.zeros(len(n), np.int64), types + 1, [0]])
    return Vocabulary(head, symbols, rest, total["n"] + n_texts, total["types"] + (n_texts > 0))


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """`rows` (id, training, text) as id, training, symbols, and the other words with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab.head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for low, high in _text_blocks(offsets):
                body, ends = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, stops, first = word_spans(body, ends)
                hashes = word_hashes(body, starts, stops).view(np.int64)
                at = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
                known = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
                symbols = np.where(known, at, len(head) + (hashes & (BUCKETS - 1))).astype(np.int32)
                owner = np.repeat(np.arange(high - low), np.diff(first))[~known]
                other = hashes[~known]
                order = np.lexsort((other, owner))
                owner, other = owner[order], other[order]
                new = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (owner[1:] != owner[:-1])])) if len(other) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(other)))
                cut = pa.array(np.searchsorted(owner[new], np.arange(high - low + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(symbols)),
                    pa.ListArray.from_arrays(cut, pa.array(other[new])), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))),
                ], names=["id", "training", "symbols", "other", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, training boolean, symbols array<int>, other array<bigint>, n array<int>")


class _Lanes:
    """Sequences side by side, the longest first: step t holds the t-th symbols of all that reach it."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.lengths = np.diff(offsets)
        self.order = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]) if len(lengths) else np.zeros(0), side="left")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lane = np.repeat(np.arange(len(lengths)), lengths)
        source = np.repeat(offsets[:-1][self.order], lengths) + step
        self.symbols = np.empty(len(source), dtype=np.int64)
        self.symbols[self.offsets[step] + lane] = values[source]


def _forward(model: Hmm, lanes: _Lanes, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log likelihood of each sequence (in their given order); states and scales of all steps if kept."""
    logs = np.zeros(len(lanes.order))
    states = np.empty((len(lanes.symbols), model.emit.shape[1])) if keep else None
    scales = np.empty(len(lanes.symbols)) if keep else None
    at = None
    for t, n in enumerate(lanes.active):
        low = lanes.offsets[t]
        seen = model.emit[lanes.symbols[low : low + n]]
        at = (model.start if at is None else at[:n] @ model.move) * seen
        scale = at.sum(axis=1)
        at /= scale[:, None]
        logs[:n] += np.log(scale)
        if keep:
            states[low : low + n], scales[low : low + n] = at, scale
    out = np.empty_like(logs)
    out[lanes.order] = logs
    return out, states, scales


def _expected(model: Hmm, lanes: _Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of one block: first states, moves, and symbols x states."""
    _, states, scales = _forward(model, lanes, keep=True)
    k = model.emit.shape[1]
    moves = np.zeros((k, k))
    ahead = np.ones((len(lanes.order), k))
    for t in range(len(lanes.active) - 1, -1, -1):
        low, n = lanes.offsets[t], lanes.active[t]
        if t + 1 < len(lanes.active):
            up, m = lanes.offsets[t + 1], lanes.active[t + 1]
            right = model.emit[lanes.symbols[up : up + m]] * ahead[:m] / scales[up : up + m, None]
            moves += states[low : low + m].T @ right
            ahead[:m] = right @ model.move.T
        if t:
            states[low : low + n] *= ahead[:n]
    first = states[: lanes.active[0]] * ahead[: lanes.active[0]] if len(lanes.active) else np.zeros((0, k))
    if len(lanes.active):
        states[: lanes.active[0]] = first
    symbols = np.stack([np.bincount(lanes.symbols, states[:, s], len(model.emit)) for s in range(k)], axis=1)
    return first.sum(axis=0), moves * model.move, symbols


def _sequences(column: pa.Array, end: int, most: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows with their symbols, the end appended; rows of over `most` symbols are cut up."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, side="right")) - 1)
        ends = offsets[at + 1 : to + 1] - offsets[at]
        flat = np.insert(values[offsets[at] : offsets[to]], ends, end)
        cuts = np.concatenate([[0], ends + np.arange(1, to - at + 1)])
        if most:
            cuts = np.unique(np.concatenate([cuts, *[np.arange(a, b, most) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > most]]))
        yield at, to, flat, cuts
        at = to


def _updated(first: np.ndarray, moves: np.ndarray, symbols: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> Hmm:
    """The model of some expected counts.  `prior` is the overall distribution of symbols and which of
    them are buckets.  Buckets are smoothed as a whole, as one symbol would be; how a state divides
    that among them is half its own counts, half the overall distribution."""
    overall, bucket = prior
    emit = symbols + PRIOR * overall[:, None]
    whole, own = emit[bucket].sum(axis=0), symbols[bucket]
    share = overall[bucket][:, None] / max(overall[bucket].sum(), 1e-300)
    emit[bucket] = whole * (0.5 * np.where(own.sum(axis=0) > 0, own / np.maximum(own.sum(axis=0), 1e-300), share) + 0.5 * share)
    return Hmm((first + 1) / (first + 1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _first_model(sample: list[np.ndarray], prior: tuple[np.ndarray, np.ndarray], end: int, states: int) -> Hmm:
    """A model from a bounded sample: states begin as single pieces; of several such starts the one that
    is likeliest after a few rounds goes on."""
    rng = np.random.default_rng(11)
    if not sample:
        return _updated(np.zeros(states), np.eye(states) * 5 + 0.1, np.zeros((len(prior[0]), states)), prior)
    flat = np.concatenate([np.append(x, end) for x in sample])
    lanes = _Lanes(flat, np.concatenate([[0], np.cumsum([len(x) + 1 for x in sample])]))
    best, reached = None, -np.inf
    for _ in range(STARTS):
        symbols = np.zeros((len(prior[0]), states))
        for s in range(states):
            np.add.at(symbols[:, s], sample[int(rng.integers(len(sample)))], 1.0)
        model = _updated(np.zeros(states), np.eye(states) * 5 + 0.1, symbols, prior)
        for _ in range(START_ROUNDS):
            model = _updated(*_expected(model, lanes), prior)
        likely = _forward(model, lanes, keep=False)[0].sum()
        if likely > reached:
            best, reached = model, likely
    for _ in range(SAMPLE_ROUNDS):
        best = _updated(*_expected(best, lanes), prior)
    return best


def _round(encoded: DataFrame, model: Hmm, prior: tuple[np.ndarray, np.ndarray], n_tokens: int) -> Hmm:
    """One Baum-Welch round over all training rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple: workers need not know its class
    k, size = model.emit.shape[1], len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, sums = Hmm(*shared.value), None
        for batch in batches:
            for _, _, flat, cuts in _sequences(batch.column(0), size - 1, SEGMENT):
                got = _expected(hmm, _Lanes(flat, cuts))
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
        if sums is not None:
            # Places: symbols x states, then moves, then first states.
            flat = np.concatenate([sums[2].ravel(), sums[1].ravel(), sums[0]])
            hit = np.flatnonzero(flat > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(flat[hit])], names=["place", "x"])

    tasks = max(encoded.sparkSession.sparkContext.defaultParallelism, n_tokens // TASK_WORDS)
    rows = encoded.where("training").select("symbols").coalesce(tasks).mapInArrow(run, "place bigint, x double")
    got = rows.groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(size * k + k * k + k)
    flat[got["place"].to_numpy()] = got["x"].to_numpy()
    return _updated(flat[size * k + k * k :], flat[size * k : size * k + k * k].reshape(k, k), flat[: size * k].reshape(size, k), prior)


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    overall = vocab.counts + np.where(vocab.rest > 0, vocab.rest, 1.0)
    prior = overall / overall.sum(), vocab.rest > 0

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            cuts, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
            cuts = np.unique(np.concatenate([cuts, *[np.arange(a, b, PIECE) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > PIECE]]))
            hashes = mix(np.add.reduceat(mix(values.astype(np.uint64)), cuts[:-1])) if len(values) else np.zeros(0, np.uint64)
            for i in np.argsort(hashes, kind="stable")[:SAMPLE]:
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 1].view(np.int64)), pa.array([values[cuts[i] : cuts[i + 1]]], pa.list_(pa.int32()))], names=["hash", "symbols"])

    picked = encoded.where("training").select("symbols").mapInArrow(pieces, "hash bigint, symbols array<int>").orderBy("hash", "symbols").limit(SAMPLE).toArrow()
    sample = [np.array(x, dtype=np.int64) for x in picked["symbols"].to_pylist()]
    model = _first_model(sample, prior, len(overall) - 1, states)
    for _ in range(rounds):
        model = _round(encoded, model, prior, vocab.n_tokens)
    return model


def score(docs: DataFrame, training, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, training, n_tokens, n_known, train_tokens, base_score, score.

    `training` is a boolean Column that marks the rows to learn from.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = shared_table(word_counts(rows.where("training").select("text")), "lm-counts")
    vocab = vocabulary(counts, rows.where("training").count())
    encoded = shared_table(encode(rows, vocab).withColumn("row", F.monotonically_increasing_id()), "lm-encoded")
    model = train(encoded, vocab)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tuple(model), np.log10(vocab.counts + 1.0), vocab.counts > 0, vocab.rest > 0, np.log10(np.where(vocab.rest > 0, vocab.counts + vocab.rest, 1.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (start, move, emit), logs, known, other, shares = shared.value
        hmm, end = Hmm(start, move, emit), len(logs) - 1
        for batch in batches:
            for at, to, flat, cuts in _sequences(batch.column(3), end, None):
                got, _, _ = _forward(hmm, _Lanes(flat, cuts), keep=False)
                base = np.add.reduceat(np.where(other[flat], 0.0, logs[flat]), cuts[:-1])
                sure = np.add.reduceat((~other[flat] & known[flat]).astype(np.int64), cuts[:-1])
                # Of a bucket's probability, other words have their shares, whose counts are joined below.
                path = got / np.log(10) - np.add.reduceat(shares[flat], cuts[:-1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, to - at) for i in range(3)], pa.array(np.diff(cuts)), pa.array(sure), pa.array(base), pa.array(path)], names=["id", "training", "row", "n_tokens", "known", "base", "path"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = encoded.select("id", "training", "row", "symbols").mapInArrow(run, f"id {kind}, training boolean, row bigint, n_tokens bigint, known bigint, base double, path double")
    others = encoded.select("row", F.explode(F.arrays_zip("other", "n")).alias("x")).select("row", F.col("x.other").alias("hash"), F.col("x.n").alias("times"))
    met = others.join(counts, "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("other_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("other_base")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    space = float(np.log10(vocab.n_tokens + vocab.n_types + 1))
    return scored.join(met, "row", "left").select(
        F.col("id").alias(id_column), "training", F.col("n_tokens"), (F.col("known") + zero("other_known")).cast("long").alias("n_known"), F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("other_base") - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("path") + zero("other_base")).alias("score"),
    )


ship_by_value(__name__)
