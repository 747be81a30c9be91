"""SentencePiece encoding and decoding by the best-scoring segmentation, a max-plus parallel scan.

The vocabulary is that of a public SentencePiece model file; its merge ranks become integer
scores, -round(16 * log2(rank + 2)), so sums are exact and every part of the computation agrees on
ties (the longest last piece wins).  Blanks are part of pieces, the text gets one leading blank, and
characters without a piece are written as bytes, so decoding gives back every text exactly.

Every text is cut into chunks of CHUNK characters.  The state at a chunk's border is how far the
last piece runs past it, so a chunk is a max-plus matrix from entry to exit states:

1. the pieces that match anywhere in a chunk are found by walking a double-array trie, all
   characters of many chunks at once;
2. the matrix of each chunk comes from a Viterbi recursion over its characters for all entry states,
   many chunks side by side; once all open places rank the entry states alike, one number a place
   says it all;
3. matrices are combined associatively, in a tree, into the best score of each entry state;
4. given its entry scores, each chunk finds the entry state of each exit state by itself; these maps
   are followed from the last chunk back, and each chunk traces its pieces by itself.

Rows hold segments of at most SEGMENT chunks.  The segments of a longer text are dealt to all tasks;
each yields its matrix, Spark combines the matrices by groups of FAN, level by level, and the entry
and exit states come back to the segments the same way.

Defined results.  A null or empty text has no tokens and decodes to the empty text.  Repeated rows
are encoded each.  `token_ids` and `round_trip` take the place of columns with these names; columns
of any other name stay.  Ids that no piece has are an error.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import drop_table, shared_table, ship_by_value

#: Characters of a chunk, chunks of a segment, matrices that one step of the tree combines.
CHUNK, SEGMENT, FAN = 512, 64, 16
#: Chunks side by side, and characters that the recursion for all entry states takes before it looks.
LANES, WARM = 1024, 48
#: Ids decoded at a time.
DECODED = 1 << 18
#: No path: far below any score, far from overflow.
NEVER = -(1 << 60)
_NONE = np.int32(-(1 << 29))

_BLANK_MARK = "▁"
_NORMAL, _BYTE = 1, 6


def piece_table(path: str) -> tuple:
    """The model at `path` as plain arrays: a double-array trie over its characters, and its pieces.

    chars, base, check, piece (the id that ends at a place, or -1), scores by id, the ids of the 256
    bytes, the bytes of each id, the longest piece, the score of an unknown character.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    scores, byte_ids, shown, pieces, rank = np.zeros(len(model.pieces), np.int32), [0] * 256, [], {}, 0
    for i, p in enumerate(model.pieces):
        if p.type == _NORMAL:
            scores[i] = -round(16 * np.log2(rank + 2))
            rank += 1
            text = p.piece.replace(_BLANK_MARK, " ")
            pieces[text] = i
            shown.append(text.encode())
        elif p.type == _BYTE:
            value = int(p.piece[3:5], 16)
            byte_ids[value] = i
            shown.append(bytes([value]))
        else:
            shown.append(b"")
    chars = sorted({c for text in pieces for c in text})
    number = {c: n for n, c in enumerate(chars, start=1)}
    children: dict[str, list[str]] = {}
    for prefix in {text[:n] for text in pieces for n in range(1, len(text) + 1)}:
        children.setdefault(prefix[:-1], []).append(prefix)
    # First fit: a node's children stand at base + number, at places that are free for all of them.
    size = 2 * sum(map(len, children.values())) + 4 * len(chars)
    base, check, piece, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    used[0], place = True, {"": 0}
    free = 1
    for node in sorted(children, key=lambda x: (len(x), -len(children[x]), x)):
        offsets = np.array([number[c[-1]] for c in children[node]])
        while used[free]:
            free += 1
        for low in range(free, size, 4096):
            starts = low + np.flatnonzero(~used[low : low + 4096]) - offsets[0]
            starts = starts[(starts >= 0) & (starts + offsets.max() < size)]
            fits = np.flatnonzero(~used[starts[:, None] + offsets].any(axis=1)) if len(starts) else starts
            if len(fits):
                break
        at = int(starts[fits[0]])
        base[place[node]] = at
        for child, offset in zip(children[node], offsets):
            used[at + offset], check[at + offset], place[child] = True, place[node], at + int(offset)
            piece[at + offset] = pieces.get(child, -1)
    return np.array([ord(c) for c in chars]), base, check, piece, scores, np.array(byte_ids, np.int32), shown, max(map(len, pieces)), int(scores.min()) - 10


class _Pieces:
    """What a Python worker makes of the table, once."""

    made: dict[int, _Pieces] = {}

    def __init__(self, table: tuple):
        chars, self.base, self.check, self.piece, self.scores, self.byte_ids, self.bytes, self.longest, self.unknown = table
        self.number = np.zeros(0x110001, dtype=np.int16)
        self.number[chars] = np.arange(1, len(chars) + 1)
        #: Scores are held times 2 ** shift; the low bits are the length of the last piece, all ones for an entry.
        self.shift = int(self.longest + 1).bit_length()
        self.mask = np.int32((1 << self.shift) - 1)
        self.gains = self.scores << self.shift


def _pieces(table: tuple) -> _Pieces:
    key = zlib.crc32(table[2].tobytes()) ^ zlib.crc32(table[4].tobytes())
    if key not in _Pieces.made:
        _Pieces.made.clear()
        _Pieces.made[key] = _Pieces(table)
    return _Pieces.made[key]


class _Chunks:
    """Chunks side by side.  `codes` holds a column of CHUNK + longest - 1 characters for each, `core`
    how many of them are its own."""

    def __init__(self, pieces: _Pieces, codes: np.ndarray, core: np.ndarray):
        self.pieces, self.codes, self.core = pieces, codes, core
        s, lanes = pieces.longest, codes.shape[1]
        self.steps = int(core.max()) + s if len(core) else s
        flat = pieces.number[codes].reshape(-1)
        #: By the length of a piece (the longest first), the place where it ends and the chunk: score and id.
        self.gain = np.full((s, self.steps, lanes), _NONE, dtype=np.int32)
        self.ids = np.empty((s, self.steps, lanes), dtype=np.int32)
        gain, ids = self.gain.reshape(s, -1), self.ids.reshape(s, -1)
        at = np.flatnonzero((np.arange(int(core.max()) if len(core) else 0)[:, None] < core).reshape(-1))
        # A character without a piece of its own stands as unknown.
        gain[s - 1, at + lanes], ids[s - 1, at + lanes] = (pieces.unknown << pieces.shift) + 1, -1
        state = np.zeros(len(at), dtype=np.int32)
        for n in range(1, s + 1):
            after = pieces.base[state] + flat[at + (n - 1) * lanes]
            ok = np.flatnonzero(pieces.check[after] == state)
            at, state = at[ok], after[ok]
            found = pieces.piece[state]
            hit = np.flatnonzero(found >= 0)
            end, found = at[hit] + n * lanes, found[hit]
            gain[s - n, end] = pieces.gains[found] + n
            ids[s - n, end] = found

    def matrices(self) -> np.ndarray:
        """(chunk, entry state, exit state) best scores."""
        s, lanes, shift, mask = self.pieces.longest, self.codes.shape[1], self.pieces.shift, self.pieces.mask
        # best[p + s] is the score at place p, for places before the chunk too, where no path is.
        best = np.full((self.steps + s, s, lanes), _NONE, dtype=np.int32)
        best[s + np.arange(s), np.arange(s)] = 0
        for t in range(1, min(WARM, self.steps)):
            found = (best[t : t + s] + self.gain[:, t, None]).max(axis=0) & ~mask
            np.maximum(best[t + s], np.maximum(found, _NONE), out=best[t + s])
        if self.steps <= WARM:
            return self._exits(best)
        # Do all open places rank the entry states alike?
        open_places = best[WARM : WARM + s]
        top = open_places.max(axis=1)
        there = top > _NONE // 2
        lost = open_places <= _NONE // 2
        profile = np.where(lost, _NONE, open_places - top[:, None])
        first = np.take_along_axis(profile, there.argmax(axis=0)[None, None], axis=0)[0]
        alike = ((profile == first) | ~there[:, None]).all(axis=(0, 1))
        line = np.full((self.steps + s, lanes), _NONE, dtype=np.int32)
        line[WARM : WARM + s] = top
        for t in range(WARM, self.steps):
            line[t + s] = np.maximum((line[t : t + s] + self.gain[:, t]).max(axis=0) & ~mask, _NONE)
        ends = self._exits(line[:, None])[:, 0]
        found = np.where((first.T[:, :, None] > _NONE // 2) & (ends[:, None] > NEVER // 2), (first.T[:, :, None] >> shift) + ends[:, None], NEVER)
        # A chunk that ends within the first characters has its exits there.
        rest = np.flatnonzero(~alike | (self.core + s > WARM - 1) & (self.core < WARM))
        if len(rest):
            wide = np.full((self.steps + s, s, len(rest)), _NONE, dtype=np.int32)
            wide[: WARM + s] = best[: WARM + s, :, rest]
            gain = self.gain[:, :, rest]
            for t in range(WARM, self.steps):
                wide[t + s] = np.maximum((wide[t : t + s] + gain[:, t, None]).max(axis=0) & ~mask, _NONE)
            found[rest] = self._exits(wide, rest)
        early = np.flatnonzero(self.core + s <= WARM - 1)
        if len(early):
            found[early] = self._exits(best[:, :, early], early)
        return found

    def _exits(self, best: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
        """(chunk, entry state, exit state) of scores by place, entry state and chunk."""
        s = self.pieces.longest
        core = self.core if lanes is None else self.core[lanes]
        at = np.minimum(core[:, None] + s + np.arange(s), len(best) - 1)
        found = best[at, :, np.arange(len(core))[:, None]].transpose(0, 2, 1).astype(np.int64)
        return np.where(found > _NONE // 2, found >> self.pieces.shift, NEVER)

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Given the scores of the entry states (chunk, state): by place, the length of the last piece
        of the best path (`mask` for an entry), and (chunk, exit state) its entry state, or -1."""
        s, lanes, mask = self.pieces.longest, self.codes.shape[1], self.pieces.mask
        best = np.full((self.steps + s, lanes), _NONE, dtype=np.int32)
        back = np.zeros((self.steps, lanes), dtype=np.uint8)
        origin = np.full((self.steps, lanes), -1, dtype=np.int16)
        relative = np.maximum(entry - entry.max(axis=1, keepdims=True), int(_NONE) >> (self.pieces.shift + 1))
        given = np.where(entry.T > NEVER // 2, relative.T << self.pieces.shift, _NONE - 1).astype(np.int32) | mask
        every = np.arange(lanes)
        for t in range(self.steps):
            found = (best[t : t + s] + self.gain[:, t]).max(axis=0)
            if t < s:
                found = np.maximum(found, given[t])
            last = found & mask
            best[t + s] = np.maximum(found & ~mask, _NONE)
            back[t] = last
            origin[t] = origin[np.maximum(t - last, 0), every]
            if t < s:
                origin[t][last == mask] = t
            origin[t][found <= _NONE // 2] = -1
        at = np.minimum(self.core[:, None] + np.arange(s), self.steps - 1)
        return back, origin[at, every[:, None]]

    def tokens(self, back: np.ndarray, leave: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has, for paths that run from
        the places `enter` to the places `leave` past the ends."""
        s, lanes = self.pieces.longest, self.codes.shape[1]
        at, lane = self.core + leave, np.arange(lanes)
        found, owners, starts, count = [], [], [], np.zeros(lanes, dtype=np.int64)
        while True:
            go = np.flatnonzero(at > enter[lane])
            if not len(go):
                break
            at, lane = at[go], lane[go]
            n = back[at, lane]
            found.append(self.ids[s - n.astype(np.int64), at, lane])
            at = at - n
            count[lane] += 1
            owners.append(lane), starts.append(at)
        # The path was followed from its end.
        sizes, last = [len(x) for x in owners], np.cumsum(count) - 1
        lane = np.concatenate([*owners, np.zeros(0, np.int64)])
        order = last[lane] - np.repeat(np.arange(len(sizes)), sizes)
        ids, owner, start = np.empty(len(lane), np.int32), np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
        ids[order], owner[order], start[order] = np.concatenate([*found, np.zeros(0, np.int32)]), lane, np.concatenate([*starts, np.zeros(0, np.int64)])
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            written = [chr(c).encode("utf-8", "surrogatepass") for c in self.codes[start[unknown], owner[unknown]]]
            n = np.ones(len(ids), dtype=np.int64)
            n[unknown] = [len(x) for x in written]
            first = (np.cumsum(n) - n)[unknown]
            ids, owner = np.repeat(ids, n), np.repeat(owner, n)
            for at, x in zip(first, written):
                ids[at : at + len(x)] = self.pieces.byte_ids[list(x)]
        return ids, np.bincount(owner, minlength=lanes)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices, the last two axes of `a` and `b`."""
    out = np.full(a.shape, NEVER, dtype=np.int64)
    for k in range(a.shape[-1]):
        np.maximum(out, np.maximum(a[..., :, k, None] + b[..., k, None, :], NEVER), out=out)
    return out


def scan(entry: np.ndarray, matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of matrices (row, k, state, state), as many as a power of two: the scores of the
    states before each, from those before the first, and the product of each row; by a tree."""
    if matrices.shape[1] == 1:
        return entry[:, None], matrices[:, 0]
    before, whole = scan(entry, product(matrices[:, 0::2], matrices[:, 1::2]))
    after = np.maximum((before[..., :, None] + matrices[:, 0::2]).max(axis=2), NEVER)
    return np.stack([before, after], axis=2).reshape(len(entry), -1, entry.shape[1]), whole


def _identity(states: int) -> np.ndarray:
    return np.where(np.eye(states, dtype=bool), 0, NEVER).astype(np.int64)


def _solved(pieces: _Pieces, texts: list[str], core: np.ndarray, entry: np.ndarray | None, leave: np.ndarray | None, want: str) -> Iterator[tuple[int, int, object]]:
    """Segments `texts`, each with the characters after it that its pieces may run into; `core` are
    its own.  Yields (from, to, result) by runs of segments: their matrices (segment, state, state),
    with `entry` scores the entry state of each exit state, or with `leave` too, ids and counts."""
    s = pieces.longest
    n_chunks = np.maximum(-(-core // CHUNK), 1)
    order, low = np.cumsum(np.concatenate([[0], n_chunks])), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(order, order[low] + LANES, side="right")) - 1)
        k, lanes = n_chunks[low:high], int(order[high] - order[low])
        owner = np.repeat(np.arange(high - low), k)
        place = np.arange(lanes) - np.repeat(order[low:high] - order[low], k)
        joined = np.frombuffer("".join(texts[low:high]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.array([len(x) for x in texts[low:high]])
        begin = (np.cumsum(length) - length)[owner] + place * CHUNK
        own = np.minimum(core[low:high][owner] - place * CHUNK, CHUNK)
        reach = np.minimum(length[owner] - place * CHUNK, own + s - 1)
        rows = np.arange(int(own.max()) + s - 1)[:, None]
        inside = rows < reach
        codes = np.where(inside, joined[np.where(inside, begin + rows, 0)] if len(joined) else 0, 0x110000)
        chunks = _Chunks(pieces, codes, own)
        given = np.full((high - low, s), NEVER, dtype=np.int64)
        if entry is None:
            given[:, 0] = 0
        else:
            given[:] = entry[low:high]
        width = np.array([1 << int(x - 1).bit_length() for x in k])
        before, whole = given[owner], np.empty((high - low, s, s), dtype=np.int64) if want == "matrix" else None
        matrices = chunks.matrices() if want == "matrix" or k.max() > 1 else None
        for w in np.unique(width if want == "matrix" else width[width > 1]).tolist():
            of, on = np.flatnonzero(width == w), np.flatnonzero(width[owner] == w)
            padded = np.broadcast_to(_identity(s), (len(of), w, s, s)).copy()
            row = np.searchsorted(of, owner[on])
            padded[row, place[on]] = matrices[on]
            got, product_of = scan(given[of], padded)
            before[on] = got[row, place[on]]
            if want == "matrix":
                whole[of] = product_of
        if want == "matrix":
            yield low, high, whole
        else:
            back, origin = chunks.paths(before)
            # From the last chunk back, all segments together.
            first, most = order[low:high] - order[low], int(k.max())
            if want == "map":
                state = np.tile(np.arange(s, dtype=np.int64), (high - low, 1))
                for at in range(most - 1, -1, -1):
                    of = np.flatnonzero(k > at)
                    state[of] = np.where(state[of] >= 0, origin[(first[of] + at)[:, None], np.maximum(state[of], 0)], -1)
                yield low, high, state
            else:
                state, ends = leave[low:high].copy(), np.zeros((2, lanes), dtype=np.int64)
                for at in range(most - 1, -1, -1):
                    of = np.flatnonzero(k > at)
                    chunk = first[of] + at
                    ends[0, chunk] = state[of]
                    state[of] = ends[1, chunk] = origin[chunk, state[of]]
                ids, n = chunks.tokens(back, *ends)
                yield low, high, (ids, np.bincount(owner, n, high - low).astype(np.int64))
        low = high


def _segment_rows(texts: DataFrame, longest: int, size: int) -> DataFrame:
    """`texts` (row, text) as (row, k, core, text): segments of `size` characters and what follows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = " " + text
                for k, at in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([k], pa.int32()), pa.array([min(size, len(text) - at)], pa.int32()), pa.array([text[at : at + size + longest - 1]])], names=["row", "k", "core", "text"]
                    )

    return texts.mapInArrow(split, "row bigint, k int, core int, text string")


def _entries(matrices: DataFrame, states: int) -> DataFrame:
    """From (row, k, matrix): (row, k, entry), the scores of the states before each k; a tree of groups of FAN."""
    power = 1 << (FAN - 1).bit_length()

    def padded(group: pd.DataFrame) -> np.ndarray:
        out = np.broadcast_to(_identity(states), (1, power, states, states)).copy()
        out[0, group["k"].to_numpy() % FAN] = np.stack(group["matrix"].to_list()).reshape(-1, states, states)
        return out

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        _, out = scan(np.zeros((1, states), dtype=np.int64), padded(group))
        return pd.DataFrame({"row": group["row"].iloc[:1], "k": group["k"].iloc[:1] // FAN, "matrix": [out[0].ravel()]})

    def before(group: pd.DataFrame) -> pd.DataFrame:
        at = group["k"].to_numpy() % FAN
        out, _ = scan(np.array([group["entry"].iloc[0]]), padded(group))
        return pd.DataFrame({"row": group["row"], "k": group["k"], "entry": list(out[0, at])})

    block = F.floor(F.col("k") / FAN).cast("int")
    start = F.array([F.lit(0 if i == 0 else NEVER).cast("long") for i in range(states)])
    if matrices.agg(F.max("k")).first()[0] < FAN:
        above = matrices.select("row", F.lit(0).alias("block")).distinct().withColumn("entry", start)
    else:
        blocks = shared_table(matrices.groupBy("row", block.alias("block")).applyInPandas(whole, "row bigint, k int, matrix array<bigint>"), "piece-blocks")
        above = _entries(blocks, states).select("row", F.col("k").alias("block"), "entry")
    met = matrices.withColumn("block", block).join(above, ["row", "block"])
    return met.groupBy("row", "block").applyInPandas(before, "row bigint, k int, entry array<bigint>")


def _leaves(maps: DataFrame) -> DataFrame:
    """From (row, k, map), the entry state of each exit state: (row, k, leave), the exit state of each
    k, from state 0 after the last; the same tree, from the end."""

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        found = None
        for one in group.sort_values("k")["map"]:
            found = one if found is None else np.where(one >= 0, found[np.maximum(one, 0)], -1)
        return pd.DataFrame({"row": group["row"].iloc[:1], "k": group["k"].iloc[:1] // FAN, "map": [found]})

    def back(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ascending=False)
        state, out = int(group["leave"].iloc[0]), []
        for one in group["map"]:
            out.append(state)
            state = int(one[state])
        return pd.DataFrame({"row": group["row"], "k": group["k"], "leave": out})

    block = F.floor(F.col("k") / FAN).cast("int")
    if maps.agg(F.max("k")).first()[0] < FAN:
        above = maps.select("row", F.lit(0).alias("block")).distinct().withColumn("leave", F.lit(0))
    else:
        blocks = shared_table(maps.groupBy("row", block.alias("block")).applyInPandas(whole, "row bigint, k int, map array<int>"), "piece-blocks")
        above = _leaves(blocks).select("row", F.col("k").alias("block"), "leave")
    return maps.withColumn("block", block).join(above, ["row", "block"]).groupBy("row", "block").applyInPandas(back, "row bigint, k int, leave int")


def _encode_long(texts: DataFrame, table, longest: int, size: int) -> DataFrame:
    """`texts` (row, text) of several segments each as (row, token_ids)."""

    def each(want: str, names: list[str], types: list[pa.DataType]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(table.value)
            for batch in batches:
                texts, core = batch.column(3).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=np.int64)
                entry = np.array(batch.column(4).to_pylist(), dtype=np.int64) if want != "matrix" else None
                leave = np.array(batch.column(5).to_pylist(), dtype=np.int64) if want == "ids" else None
                if len(texts) == 0:
                    continue
                for low, high, got in _solved(pieces, texts, core, entry, leave, want):
                    if want == "ids":
                        cut = np.concatenate([[0], np.cumsum(got[1])])
                        values = [got[0][a:b] for a, b in zip(cut[:-1], cut[1:])]
                    else:
                        values = list(got.reshape(high - low, -1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(values, types[0])], names=["row", "k", *names])

        return run

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    rows = shared_table(_segment_rows(texts, longest, size).repartition(F.col("row"), F.col("k")), "piece-segments")
    matrices = shared_table(rows.mapInArrow(each("matrix", ["matrix"], [longs]), "row bigint, k int, matrix array<bigint>"), "piece-matrices")
    entered = shared_table(rows.join(_entries(matrices, longest), ["row", "k"]).select("row", "k", "core", "text", "entry"), "piece-entries")
    drop_table(rows)
    drop_table(matrices)
    maps = shared_table(entered.mapInArrow(each("map", ["map"], [ints]), "row bigint, k int, map array<int>"), "piece-maps")
    left = entered.join(_leaves(maps), ["row", "k"]).select("row", "k", "core", "text", "entry", "leave")
    found = left.mapInArrow(each("ids", ["ids"], [ints]), "row bigint, k int, ids array<int>")
    return found.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("token_ids"))


def _decoded(table: list[bytes], flat: np.ndarray, cut: np.ndarray) -> Iterator[str]:
    """The texts of ids that lie one after the other; a bounded number of ids is listed at a time."""
    at = 0
    while at < len(cut) - 1:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + DECODED, side="right")) - 1)
        ids = flat[cut[at] : cut[to]].tolist()
        for a, b in zip((cut[at:to] - cut[at]).tolist(), (cut[at + 1 : to + 1] - cut[at]).tolist()):
            yield b"".join(map(table.__getitem__, ids[a:b])).decode("utf-8", "surrogatepass")[1:]
        at = to


def _numbered(docs: DataFrame, kept: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]


def encode(docs: DataFrame, model_path: str, text_column: str = "text", segment: int = SEGMENT, check: bool = False) -> DataFrame:
    """`docs` with the text column replaced by `token_ids`; other columns stay.

    With `check`, `round_trip` tells whether decoding the ids gives the text back.
    """
    spark: SparkSession = docs.sparkSession
    made = piece_table(model_path)
    longest, size = made[7], segment * CHUNK
    table = spark.sparkContext.broadcast(made)
    extra = ["round_trip"] if check else []
    kept = [c for c in docs.columns if c not in (text_column, "token_ids", *extra)]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*_numbered(docs, kept), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        pieces = _pieces(table.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            chars = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(-(-(chars + 1) // CHUNK))])
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + LANES, side="right")) - 1)
                texts = column.slice(at, to - at).to_pylist()
                core = np.where(chars[at:to] > 0, chars[at:to] + 1, 0)
                for low, high, (flat, n) in _solved(pieces, [" " + t if t else "" for t in texts], core, None, np.zeros(to - at, dtype=np.int64), "ids"):
                    cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    found = [pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.astype(np.int32)))]
                    if check:
                        found.append(pa.array([a == b for a, b in zip(texts[low:high], _decoded(pieces.bytes, flat, cut))], pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at + low, high - low) for i in range(batch.num_columns - 1)], *found], names=[*names, "token_ids", *extra])
                at = to

    types = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["token_ids array<int>"] + ["round_trip boolean"] * check
    out = rows.where(F.length("text") < size).mapInArrow(run, ", ".join(types))
    longer = shared_table(rows.where(F.length("text") >= size).withColumn("row", F.monotonically_increasing_id()), "piece-longer")
    if not longer.isEmpty():
        ids = longer.join(_encode_long(longer.select("row", "text"), table, longest, size), "row").drop("row")
        if check:
            ids = decode(ids, model_path, "decoded_text").withColumn("round_trip", F.col("text") == F.col("decoded_text")).drop("decoded_text")
        out = out.unionByName(ids.drop("text"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "token_ids", *extra)


def decode(encoded: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """`encoded` with `token_ids` and the decoded text; other columns stay."""
    shown = encoded.sparkSession.sparkContext.broadcast(piece_table(model_path)[6])
    kept = [c for c in encoded.columns if c != text_column]
    names = [f"c{i}" for i in range(len(kept))]
    place = kept.index("token_ids")
    rows = encoded.select(*_numbered(encoded, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shown.value
        for batch in batches:
            column = batch.column(place)
            texts = _decoded(table, column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{types}, decoded string").select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("decoded").alias(text_column))


ship_by_value(__name__)
