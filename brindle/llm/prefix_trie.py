"""Conversation prefix trie: who shares which opening turns, and how many words that saves.

A conversation is a string of 20-byte letters, one a turn: 128 bits of the SHA-256 of role and text,
then the text's word count; so letters sort bytewise and texts are never moved.

Patricia construction.  The strings are sorted by ranges into partitions of about equal size; a string
that many conversations share may run over several.  A partition goes through its sorted strings once
with a stack of points on the open path: ends of conversations, branches (where the next string turns
off) and leaves.  A point that is left is complete: it adds its counts to the point above, and its edge,
which may span many turns, is expanded into a node a turn, all with the counts of the edge's lower end,
the saved words growing by suffix sums of (n_convs - 1) * words along the edge.

Across partitions.  A node above the common prefix of two neighbouring partitions has conversations in
both.  Each states its part of such a node, and the parts are added: of n_convs conversations one, the
first in order, starts the node, so the parts' (conversations - starts) * words add up to
(n_convs - 1) * words, and likewise below it; a child or a leaf is counted where it starts or ends.
Such rows number at most the partitions times the depth of their borders, whatever the groups of copies.

`ends_sha256` hashes all ids of an end in order, which nothing can split.  A partition hashes the ends
it holds alone; of an end that may lie across partitions it sends the ids in pieces of PIECE_IDS, which
one task hashes as a stream, in constant memory.

Defined results.  Null turns sort first; rows of equal turn are ordered by role, then by the hash of
their text.  Null roles and texts are empty.  Rows without a conversation id belong to no conversation
and are left out.  No conversations: no rows.  Other columns are not read.  A conversation is one value
of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_PATTERN, shared_table, ship_by_value

LETTER = 20
PIECE_IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: kind 0: whole nodes; 1: a partition's part of a node; 2: a piece of the ids of an end.
NODE = "kind int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, ids string"


def letters(turns: DataFrame) -> DataFrame:
    """conv_id, path: each conversation as one string of letters."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps (role, text) apart from every other pair.
    said = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    count = F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"))), 8, "0")
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), F.concat(said, count).alias("letter")).alias("t"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["letter"]), "")
    return rows.groupBy("conv_id").agg(F.unhex(path).alias("path"))


def regrow(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c starts with the first crc32(c) % most turns of conversation c - c % every."""
    heads = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, LETTER * (most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = paths.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    head = F.substr(F.coalesce("head", F.unhex(F.lit(""))), F.lit(1), F.col("h") * LETTER)
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.substr("path", F.col("h") * LETTER + 1)).alias("path"))


def _common(a: bytes, b: bytes) -> int:
    """Whole letters that two strings have in common at their start."""
    low, high = 0, min(len(a), len(b)) // LETTER
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * LETTER] == b[: mid * LETTER] else (low, mid - 1)
    return low


class _Point:
    """A branch, end or leaf on the open path."""

    __slots__ = ("bare", "children", "depth", "first", "ids", "leaves", "low", "n", "saved", "tops")

    def __init__(self, depth: int, first: int):
        # bare: nothing in this partition lies below; first: number of the first string below; tops: nodes right below, which wait for this one's smallest id.
        self.bare, self.depth, self.first, self.n, self.low, self.leaves, self.children, self.saved, self.ids, self.tops = True, depth, first, 0, None, 0, 0, 0, [], []

    def add(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None or low < self.low else self.low


class _Partition:
    """The nodes of one sorted partition; `left` and `right` are the turns its first and last string
    share with the neighbouring partitions, -1 without one."""

    def __init__(self, left: int, right: int):
        self.left, self.right, self.rows = left, right, []
        self.stack = [_Point(0, 0)]
        self.path, self.words, self.number, self.last = b"", [0], 0, False

    def turn_to(self, path: bytes, ids: list[int]) -> None:
        """The next string, with the ids that end there, ascending."""
        if self.number:
            self.leave(_common(self.path, path))
        self.path, self.words = path, [0]
        for i in range(LETTER - 4, len(path), LETTER):
            self.words.append(self.words[-1] + int.from_bytes(path[i : i + 4], "big"))
        if len(path) // LETTER > self.stack[-1].depth:
            self.stack.append(_Point(len(path) // LETTER, self.number))
        end = self.stack[-1]
        end.ids = ids
        end.add(len(ids), ids[0])
        self.number += 1

    def leave(self, depth: int) -> None:
        """Complete all points deeper than `depth`; where the path goes on from an edge, it branches."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, point.first))
            self.expand(point, self.stack[-1])

    def finish(self) -> list[tuple]:
        if self.number:
            self.last = True
            self.leave(0)
            self.expand(self.stack.pop(), None)
        return self.rows

    def key(self, depth: int) -> bytes:
        return hashlib.sha256(self.path[: depth * LETTER]).digest()[:16]

    def expand(self, point: _Point, above: _Point | None) -> None:
        """Nodes of the edge that ends at the point, from below; then the sums go to the point above."""
        inherited = self.left if point.first == 0 else -1  # nodes to this depth start in a partition before
        border = max(inherited, self.right if self.last else -1)  # nodes to this depth lie in others too
        if point.bare and not (self.last and self.right >= point.depth):
            point.leaves = 1
        saved, stop = point.saved, above.depth if above else -1
        for d in range(point.depth, stop, -1):
            own = d == point.depth
            saved += (point.n - (d > inherited)) * (self.words[d] - self.words[d - 1]) if d else 0
            if d <= border:
                children = point.children if own else int(d >= inherited)
                self.rows.append((1, d, self.key(d), self.key(d - 1) if d else None, point.low, None, point.n, children, point.leaves, saved, None, None))
                for i in range(0, len(point.ids) if own else 0, PIECE_IDS):
                    part = point.ids[i : i + PIECE_IDS]
                    self.rows.append((2, d, self.key(d), None, part[0], None, None, None, None, None, None, ",".join(map(str, part))))
            else:
                ends = hashlib.sha256(",".join(map(str, point.ids)).encode()).hexdigest() if own and point.ids else EMPTY
                node = [0, d, None, None, point.low, point.low if d > stop + 1 else None, point.n, point.children if own else 1, point.leaves, saved, ends, None]
                if d > 0 and d - 1 <= border and d - 1 > stop:
                    node[3], node[5] = self.key(d - 1), None
                if d == stop + 1 and above:
                    above.tops.append(node)
                else:
                    self.rows.append(tuple(node))
            if own:
                # The nodes right below the point: their parent is whole here, or has parts elsewhere.
                for top in point.tops:
                    top[3], top[5] = (self.key(d), None) if d <= border else (None, point.low)
                    self.rows.append(tuple(top))
        if above:
            above.bare = False
            above.add(point.n, point.low)
            above.saved, above.leaves = above.saved + saved, above.leaves + point.leaves
            above.children += not (point.first == 0 and self.left > above.depth)


def _grown(frame):
    """The rows of `NODE` of one partition: path, conv_id, lcp_left, lcp_right."""
    import pandas as pd
    from itertools import groupby

    part = _Partition(int(frame["lcp_left"].iloc[0]), int(frame["lcp_right"].iloc[0]))
    rows = sorted(zip(map(bytes, frame["path"]), frame["conv_id"].tolist()))
    for path, group in groupby(rows, key=lambda r: r[0]):
        part.turn_to(path, [i for _, i in group])
    names = [c.split()[0] for c in NODE.split(", ")]
    found = pd.DataFrame(part.finish(), columns=names, dtype=object)
    return found.astype({c: "Int64" for c in names if c not in ("key", "parent_key", "ends_sha256", "ids")})


def _neighbours(frames) -> Iterator:
    for frame in frames:
        for side, other, mine in (("lcp_left", "before", "first"), ("lcp_right", "after", "last")):
            frame[side] = [-1 if a is None else _common(a, b) for a, b in zip(frame[other], frame[mine])]
        yield frame[["part", "lcp_left", "lcp_right"]]


def _hashed(frames) -> Iterator:
    """key, ends_sha256 from sorted pieces; the ids of a key pass as a stream."""
    import pandas as pd

    key, state = None, None
    for frame in frames:
        done = []
        for k, ids in zip(map(bytes, frame["key"]), frame["ids"]):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def nodes(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, path)."""
    dealt = shared_table(paths.repartitionByRange("path", "conv_id").withColumn("part", F.spark_partition_id()), "trie-paths")
    # One row per partition of the sort: its border strings beside those of the next and the one before.
    borders = dealt.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")
    borders = borders.select("part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    borders = shared_table(borders.mapInPandas(_neighbours, "part int, lcp_left int, lcp_right int"), "trie-borders")
    # Broadcast: three integers a partition.
    grown = dealt.join(F.broadcast(borders), "part").groupBy("part").applyInPandas(_grown, NODE)
    grown = shared_table(grown, "trie-nodes")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = grown.where("kind = 0").withColumnRenamed("saved", "saved_tokens")
    sums = {"n_convs": "n_convs", "n_children": "n_children", "n_leaves": "n_leaves", "saved": "saved_tokens"}
    parts = grown.where("kind = 1").groupBy("key", "depth", "parent_key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(to) for c, to in sums.items()])
    parts = shared_table(parts, "trie-parts")
    pieces = grown.where("kind = 2").select("key", "conv_id", "ids")
    ends = pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInPandas(_hashed, "key binary, ends_sha256 string")
    above = parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shared = parts.join(above, "parent_key", "left").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    below = whole.where("parent_key IS NOT NULL").drop("parent_conv_id").join(above, "parent_key")
    return whole.where("parent_key IS NULL").select(result).unionByName(below.select(result)).unionByName(shared.select(result))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of `turns` (conv_id, turn, role, text)."""
    return nodes(regrow(letters(turns)))


ship_by_value(__name__)
