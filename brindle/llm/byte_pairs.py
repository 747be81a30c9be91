"""Byte-level BPE: encode whole texts by a file of ranks, decode ids back to bytes.

A text is cut into pre-tokens by a pattern; each pre-token starts as its bytes, and the adjacent pair
of lowest rank, leftmost first, is merged until none has a rank.  A pre-token that is a token itself
is taken whole.

Rank queue.  One bucket per rank holds positions of a doubly linked list; a bitmap of three levels of
64-bit words says which buckets are filled, and find-first-set on each level picks the lowest rank.
Entries whose pair has changed since are stale and skipped when met.  So a pre-token of n bytes costs
about n steps however long it is.  The list of a run holds all new pre-tokens of a block, end to end
and never joined: as they do not depend on each other, a bucket's valid positions are merged in one
numpy step (of a run of overlapping pairs every second one, from the left).  That is the order of
one-by-one merging unless a merge makes a pair of a rank below its own; no vocabulary made by merging
does that, but where one does, the pre-tokens concerned are encoded one step at a time.

Memory.  Blocks of BLOCK characters; pre-tokens met before are kept up to KEPT and then forgotten, so
a task's memory does not grow with the input.  A text longer than a block is read match by match.

Defined results.  A null text counts as empty and has no ids.  Rows, repeated or not, each give one
row; other columns are kept, whatever their names, save that the new column replaces one of its name.
Null ids decode to no bytes, ids outside the vocabulary to null.  An empty table stays empty.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ship_by_value

BLOCK = 1 << 22
KEPT = 1 << 18


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank on a line.

    The file is read on the driver, by Spark: it is a vocabulary, of bounded size.
    """
    where = path if "://" in path else f"file://{path}"
    parts = [row[0].split() for row in spark.read.text(where).collect() if row[0].strip()]
    return {base64.b64decode(token): int(rank) for token, rank in parts}


def merge_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """What workers need: the ids of single bytes, and every pair of tokens that makes a token."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    size = max(ranks.values()) + 1
    codes, made = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                codes.append(left * (size + 1) + right)
                made.append(rank)
    order = np.argsort(np.array(codes, np.int64)) if codes else np.zeros(0, np.int64)
    return {
        "bytes": np.array([ranks[bytes([b])] for b in range(256)], np.int32), "size": np.array(size),
        "codes": np.append(np.array(codes, np.int64)[order], np.iinfo(np.int64).max), "made": np.append(np.array(made, np.int32)[order], np.int32(-1)),
    }


class RankQueue:
    """Buckets by rank; the lowest filled one is found by find-first-set on three levels of words."""

    def __init__(self, size: int):
        self.buckets: dict[int, list] = {}
        self.low = [0] * (-(-size // 64) + 1)
        self.mid = [0] * (-(-len(self.low) // 64) + 1)
        self.top = 0

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as filled."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        return found

    def first(self) -> int:
        """The lowest rank with a filled bucket, or -1."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        word = high << 6 | (self.mid[high] & -self.mid[high]).bit_length() - 1
        return word << 6 | (self.low[word] & -self.low[word]).bit_length() - 1

    def take(self, rank: int) -> list:
        """Empty a bucket."""
        word, high = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[high] &= ~(1 << (word & 63))
            if not self.mid[high]:
                self.top &= ~(1 << high)
        return self.buckets.pop(rank)


class Merger:
    def __init__(self, table: dict[str, np.ndarray]):
        self.single, self.codes, self.made, self.size = table["bytes"], table["codes"], table["made"], int(table["size"])
        self.pairs = self.looked_up(np.repeat(self.single, 256), np.tile(self.single, 256))

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 without one."""
        code = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.made[at], np.int32(-1))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each; pieces are not empty."""
        body = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = ends - np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = len(body)
        # Place n stands for "none": its id forms no pair, and what is written to it is never read.
        token = np.append(self.single[body], np.int32(self.size))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[starts] = n, n
        pair = np.full(n + 1, -1, np.int32)
        pair[: n - 1] = self.pairs[body[:-1].astype(np.int64) * 256 + body[1:]]
        pair[ends - 1] = -1
        queue, odd = RankQueue(self.size), []
        self._push(queue, np.flatnonzero(pair >= 0).astype(np.int32), pair)
        while (rank := queue.first()) >= 0:
            parts = queue.take(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[pair[at] == rank]  # else stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = self._apart(at, after)
            gone = after[at]
            beyond, low = after[gone], at[:0]
            if (close := np.flatnonzero(beyond[:-1] == at[1:])).size:
                # A pair that is there only until the next merge of this step.
                fleeting = self.looked_up(np.full(len(close), rank, np.int32), token[at[close + 1]])
                low = at[close[(fleeting >= 0) & (fleeting < rank)]]
            token[at], token[gone], pair[gone] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            touched = np.concatenate([at, before[at]])
            if len(at) > 1:
                touched = np.unique(touched)
            touched = touched[touched < n]
            new = self.looked_up(token[touched], token[after[touched]])
            pair[touched] = new
            if (low := np.append(low, touched[(new >= 0) & (new < rank)])).size:
                for i in np.unique(np.searchsorted(ends, low, "right")):
                    odd.append(int(i))
                    pair[starts[i] : ends[i]] = -1
            self._push(queue, touched[pair[touched] >= 0], pair)
        alive = token[:n] >= 0
        counts, ids = np.add.reduceat(alive, starts) if n else np.zeros(0, np.int64), token[:n][alive]
        if odd:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                split[i] = np.array(self.one_by_one(pieces[i]), np.int32)
            counts, ids = np.array([len(x) for x in split]), np.concatenate(split)
        return ids, counts

    @staticmethod
    def _push(queue: RankQueue, places: np.ndarray, pair: np.ndarray) -> None:
        if not len(places):
            return
        if len(places) == 1:
            queue.bucket(int(pair[places[0]])).append(places)
            return
        ranks = pair[places]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        first = 0
        for cut, rank in zip([*cuts.tolist(), len(places)], ranks[np.append(0, cuts)].tolist()):
            queue.bucket(rank).append(places[first:cut])
            first = cut

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a row, the first, third, ... from the left."""
        joined = np.append(False, after[at[:-1]] == at[1:])
        if not joined.any():
            return at
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(joined, 0, place))
        return at[(place - run) % 2 == 0]

    def one_by_one(self, piece: bytes) -> list[int]:
        """The same queue, one merge at a time: right for any ranks."""
        token = [int(self.single[b]) for b in piece]
        after, before = [*range(1, len(token)), -1], [*range(-1, len(token) - 1)]
        found: dict[tuple[int, int], int] = {}

        def rank_at(i: int) -> int:
            if i < 0 or after[i] < 0 or token[i] < 0:
                return -1
            key = token[i], token[after[i]]
            if key not in found:
                found[key] = int(self.looked_up(np.array([key[0]]), np.array([key[1]]))[0])
            return found[key]

        queue = RankQueue(self.size)
        for i in range(len(token)):
            if (rank := rank_at(i)) >= 0:
                queue.bucket(rank).append(i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.take(rank)
            if rank_at(i) != rank:
                continue
            gone = after[i]
            token[i], token[gone], after[i] = rank, -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for j in (before[i], i):
                if (new := rank_at(j)) >= 0:
                    heapq.heappush(queue.bucket(new), j)
        return [t for t in token if t >= 0]


class Coder:
    """Encodes texts; keeps the ids of pre-tokens already met."""

    def __init__(self, table: dict[str, np.ndarray], tokens: dict[bytes, int], pattern: str):
        import regex

        self.pattern, self.merger, self.tokens = regex.compile(pattern), Merger(table), tokens
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[str] = []

    def places(self, text: str) -> np.ndarray:
        """The number of each pre-token of a text among those seen."""
        out = []
        found = iter([self.pattern.findall(text)]) if len(text) <= BLOCK else self._matches(text)
        for pieces in found:
            seen, new = self.seen, self.new
            for piece in pieces:
                if piece not in seen:
                    seen[piece] = len(seen)
                    new.append(piece)
            out.append(np.fromiter(map(seen.__getitem__, pieces), np.int32, len(pieces)))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _matches(self, text: str) -> Iterator[list[str]]:
        matches = self.pattern.finditer(text)
        while part := [m.group() for m in islice(matches, 1 << 16)]:
            yield part

    def learn(self) -> None:
        """Give ids to the pre-tokens met since the last call."""
        if not self.new:
            return
        raw = [p.encode() for p in self.new]
        whole = [self.tokens.get(p) for p in raw]
        rest = [p for p, t in zip(raw, whole) if t is None]
        ids, counts = self.merger.merged(rest) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        known = np.fromiter((t is not None for t in whole), bool, len(whole))
        n = np.ones(len(whole), np.int64)
        n[~known] = counts
        starts = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.int32)
        flat[starts[known]] = [t for t in whole if t is not None]
        flat[np.repeat(~known, n)] = ids
        self.starts = np.append(self.starts, starts + len(self.ids))
        self.counts, self.ids, self.new = np.append(self.counts, n), np.append(self.ids, flat), []

    def spelled(self, places: np.ndarray) -> np.ndarray:
        counts = self.counts[places]
        shift = np.repeat(self.starts[places] - (np.cumsum(counts) - counts), counts)
        return self.ids[np.arange(len(shift)) + shift]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > KEPT:
            self.forget()
        places = [self.places(t) for t in texts]
        self.learn()
        return [self.spelled(p) for p in places]


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "token_ids", packed: bool = False) -> DataFrame:
    """`docs` with the ids of its texts in place of them: an array of ints, or with `packed` their
    little-endian 32-bit words as binary."""
    spark = docs.sparkSession
    ranks = read_ranks(spark, path)
    shared = spark.sparkContext.broadcast((merge_table(ranks), ranks))
    others = [f for f in docs.schema.fields if f.name not in (text_column, ids_column)]
    schema = T.StructType([*others, T.StructField(ids_column, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.binary() if packed else pa.list_(pa.int32())
        table, tokens = shared.value
        coder = Coder(table, tokens, pattern)
        for batch in batches:
            text = pc.fill_null(batch.column(0), "")
            sizes, first = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while first < batch.num_rows:
                begun = int(sizes[first - 1]) if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, begun + BLOCK, "right")))
                found = coder.encoded(text.slice(first, end - first).to_pylist())
                ids = pa.array([x.astype("<u4").tobytes() for x in found] if packed else found, kind)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=schema.names)
                first = end

    return docs.select(F.col(f"`{text_column}`"), *[F.col(f"`{f.name}`") for f in others]).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_column: str = "token_ids", bytes_column: str = "decoded") -> DataFrame:
    """`rows` with the bytes of its ids in place of them; ids are arrays or packed words."""
    spark = rows.sparkSession
    tokens = read_ranks(spark, path)
    shared = spark.sparkContext.broadcast({rank: token for token, rank in tokens.items()})
    packed = isinstance(rows.schema[ids_column].dataType, T.BinaryType)
    others = [f for f in rows.schema.fields if f.name not in (ids_column, bytes_column)]
    schema = T.StructType([*others, T.StructField(bytes_column, T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        spelled = shared.value

        def spell(ids):
            if ids is None:
                return b""
            try:
                return b"".join([spelled[i] for i in (np.frombuffer(ids, "<u4").tolist() if packed else ids)])
            except KeyError:
                return None

        for batch in batches:
            cells = batch.column(0)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = pa.array([spell(x.as_py()) for x in cells.slice(first, 256)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], out], names=schema.names)

    return rows.select(F.col(f"`{ids_column}`"), *[F.col(f"`{f.name}`") for f in others]).mapInArrow(run, schema)


ship_by_value(__name__)
