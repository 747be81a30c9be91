"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a share or more.

1. Documents with equal sets are one class; all further work is on classes.
2. Filter.  Sets of similar size that are similar enough differ in at most D elements.  Each set,
   ordered by hash, is cut at fixed places into D + 1 + s parts, so that two similar sets agree in
   s + 1 parts at least.  Empty parts are left out as long as a set has at most s of them; a set
   with more has a key for every choice of s + 1 of them, so no pair is lost.  s grows with the
   number of empty parts that is to be expected; sets for which that is too many use the keys of
   their first n - ceil(share * n) + 1 elements instead.  Only classes of which others have enough
   keys, s + 1 less the empty parts, go on.  A task sends each key once however many of its classes
   have it.
3. Global order.  The n-grams of the remaining sets are counted; the order is by number of sets,
   then by hash.  Two similar sets share one of their first n - ceil(share * n) + 1 elements, and in
   this order those are the rare ones, so a common passage or line brings nothing together.
   Classes that share such an element, directly or through others, form a group.
4. Join.  The sets of a group are put into a trie, most frequent n-grams first, so that as much as
   possible of them lies on common paths; an edge holds 64 n-grams of the order as the bits of a
   word.  Many sets walk the trie side by side, a level at a time: the overlap with a path is
   computed once for all sets below it, and a subtree is left as soon as the elements that remain on
   either side cannot reach the overlap that is needed.  A group beyond a block is dealt as pairs of
   blocks, so no task holds more than two.  A task gives the number of links of each class and, as
   links, only those that connect what it had not connected yet; pairs are never rows.
5. Those links become components.

Defined results.  Words are split at white space, A-Z lowered.  A document with fewer words than n
has its whole sequence as its one element; one without words has an empty set and no links.
Repeated rows are in one class.  A null id takes part; the component of only null ids is null.
Where one row of each component is kept, rows are told apart by id and text, not by id alone.
Columns of any name may stand beside the id and the text.  64-bit hashes stand for n-grams and for
classes.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import drop_shuffles, drop_table, shared_table, ship_by_value
from brindle.llm.components import components
from brindle.llm.hashing import mix, text_bytes, word_hashes, word_spans

#: Bytes of text handled at a time.
BLOCK = 1 << 22
#: Ratio of the largest to the smallest size that share a way of cutting.
BAND = 1.4
#: Ids of documents to look at again are broadcast up to this many, else joined.
BROADCAST_IDS = 1 << 20
#: Keys that a task combines at a time; bits of a count of keys.
COMBINED, COUNT_BITS = 1 << 21, 24
#: Classes, and elements of their sets, of one block.
BLOCK_SETS, BLOCK_ITEMS = 4096, 1 << 22
#: Elements of small groups that are joined in one call; sets that walk a trie side by side.
TOGETHER, WALKERS = 1 << 20, 256


def _sets(column, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct n-gram hashes of each text of an Arrow column."""
    raw, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        body, ends = raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, stops, first = word_spans(body, ends)
        words = word_hashes(body, starts, stops)
        with np.errstate(over="ignore"):
            grams = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
            for j in range(n):
                grams = grams * np.uint64(0x9FB21C651E98DF25) + words[j : j + len(grams)]
            grams = mix(grams)
            for i in range(to - at):
                a, b = int(first[i]), int(first[i + 1])
                if b - a >= n:
                    yield at + i, np.unique(grams[a : b - n + 1])
                elif b > a:
                    whole = np.uint64(b - a)
                    for w in words[a:b]:
                        whole = whole * np.uint64(0x9FB21C651E98DF25) + w
                    yield at + i, mix(np.array([whole], dtype=np.uint64))
                else:
                    yield at + i, np.zeros(0, np.uint64)
        at = to


def _key(found: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.md5(found.tobytes()).digest()[:8], dtype=np.int64)[0])


def _cutting(band: int, percent: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The slack s, the places of the cuts, and a salt per part, for sizes from BAND ** band up to
    BAND ** (band + 1); none for small sets, in which too many parts would be empty."""
    low, high = math.ceil(BAND**band), math.ceil(BAND ** (band + 1)) - 1
    apart = (100 - percent) * 2 * high // (100 + percent)
    # The smaller set of a pair may lie below the band by the share.
    least = max(1.0, low * percent / 100)
    slack, wanted = 0, 0 if apart == 0 else 1
    while slack < wanted:
        slack = wanted
        if slack > apart:
            return None
        empty = (apart + 1 + slack) * math.exp(-least / (apart + 1 + slack))
        wanted = max(slack, math.ceil(empty + 4 * math.sqrt(empty)))
    parts = apart + 1 + slack
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    salts = mix((np.uint64(band) << np.uint64(40)) + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return slack, cuts, salts


def _bands(size: int, percent: int) -> range:
    """The bands in which a set meets all sets that can be similar to it: its own and those above
    within reach.  A pair meets in the band of its larger set."""
    own = max(0, math.floor(math.log(size) / math.log(BAND) + 1e-9))
    while BAND ** (own + 1) <= size:
        own += 1
    while own and BAND**own > size:
        own -= 1
    top = own
    while BAND ** (top + 1) <= 100 * size // percent:
        top += 1
    return range(own, top + 1)


def _keys(found: np.ndarray, percent: int, made: dict[int, tuple | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """By band: how many of its keys a set shares at least with any similar set, and the keys; `made`
    holds the ways of cutting that were needed before."""
    for band in _bands(len(found), percent):
        if band not in made:
            made[band] = _cutting(band, percent)
        cutting = made[band]
        if cutting is None:
            # Small sets: two that are similar share one of their first elements in the order.
            first = found[: len(found) - -(-percent * len(found) // 100) + 1]
            yield band, 1, mix(first ^ mix(np.array([band + 1], dtype=np.uint64)))
            continue
        slack, cuts, salts = cutting
        edges = np.concatenate([[0], np.searchsorted(found, cuts), [len(found)]])
        full = np.flatnonzero(np.diff(edges))
        keys = mix(np.add.reduceat(mix(found), edges[full]) + salts[full])
        empty = np.flatnonzero(np.diff(edges) == 0)
        if len(empty) > slack:
            keys = np.concatenate([keys, np.array([int(np.bitwise_xor.reduce(mix(salts[list(c)]))) for c in itertools.combinations(empty.tolist(), slack + 1)], dtype=np.uint64)])
        yield band, max(1, slack + 1 - len(empty)), keys


class Trie:
    """Bit sets (rows of 64-bit words, the n-grams in their order) as a trie with a word on each edge.

    A level's nodes are the runs of rows that are equal up to its word.  A node knows its children,
    the smallest set below it and the most elements that any set below still has to come.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, after: np.ndarray):
        n = words.shape[1]
        order = np.argsort(np.ascontiguousarray(words.byteswap()).view(f"V{8 * n}").ravel(), kind="stable") if n else np.arange(len(words))
        self.rows, self.sizes, self.levels = order, sizes[order], []
        words, after = words[order], after[order]
        begins = np.zeros(len(words), dtype=bool)
        begins[:1] = True
        above = np.flatnonzero(begins)
        for level in range(n):
            begins[1:] |= words[1:, level] != words[:-1, level]
            starts = np.flatnonzero(begins)
            first = np.searchsorted(starts, above)
            self.levels.append((
                first, np.diff(np.append(first, len(starts))), words[starts, level],
                np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(after[:, level], starts), np.append(starts[1:], len(words)),
            ))
            above = starts
        self.ends = above, np.diff(np.append(above, len(words)))

    def walk(self, words: np.ndarray, sizes: np.ndarray, after: np.ndarray, least: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets `words` walk side by side: (place in the trie, set, overlap) of what was not left.

        A set meets the places from `least` on only.
        """
        node, walker = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        overlap = np.zeros(len(words), dtype=np.int64)
        for level, (first, children, word, smallest, most, ends) in enumerate(self.levels):
            n = children[node]
            walker, overlap = np.repeat(walker, n), np.repeat(overlap, n)
            node = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(len(walker))
            overlap += np.bitwise_count(word[node] & words[walker, level])
            need = -(-percent * (sizes[walker] + smallest[node]) // (100 + percent))
            stay = np.flatnonzero((overlap + np.minimum(most[node], after[walker, level]) >= need) & (ends[node] > least[walker]))
            node, walker, overlap = node[stay], walker[stay], overlap[stay]
        starts, n = self.ends[0][node], self.ends[1][node]
        walker, overlap = np.repeat(walker, n), np.repeat(overlap, n)
        place = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(walker))
        stay = np.flatnonzero(place >= least[walker])
        return place[stay], walker[stay], overlap[stay]


def linked(sets: list[np.ndarray], sizes: np.ndarray, percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of some sets, the number of sets that each is similar to, and links that connect all that are
    connected.  `sizes` are those of the whole sets; `sets` may lack elements that no two have.

    With `left`, a boolean per set, only pairs of a left and another set count.
    """
    owner, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, item, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), dtype=np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
    common = max(2, len(sets) // 32)
    n_words = -(-int((times >= common).sum()) // 64)
    on_path = times[item] >= common
    words = np.zeros((len(sets), n_words), dtype=np.uint64)
    place = rank[item[on_path]]
    np.bitwise_or.at(words.reshape(-1), owner[on_path] * n_words + (place >> 6), np.uint64(1) << (63 - (place & 63)).astype(np.uint64))
    # Rare n-grams lie behind the paths: their overlap is looked up for the few pairs that need it.
    behind = ~on_path & (times[item] > 1)
    rest = np.sort(owner[behind] * len(times) + item[behind])
    rest_of = np.bincount(owner[behind], minlength=len(sets))
    rest_at = np.cumsum(rest_of) - rest_of
    after = np.cumsum(np.bitwise_count(words[:, ::-1]).astype(np.int64), axis=1)[:, ::-1]
    after = np.hstack([after[:, 1:], np.zeros((len(sets), min(n_words, 1)), dtype=np.int64)]) + rest_of[:, None]
    inside = np.arange(len(sets)) if left is None else np.flatnonzero(left)
    trie = Trie(words[inside], sizes[inside], after[inside])
    if left is None:
        walkers, least = inside[trie.rows], np.arange(1, len(sets) + 1)
    else:
        walkers = np.flatnonzero(~left)
        least = np.zeros(len(walkers), dtype=np.int64)
    counts, links, label = np.zeros(len(sets), dtype=np.int64), [], np.arange(len(sets))
    for low in range(0, len(walkers), WALKERS):
        own = walkers[low : low + WALKERS]
        at, walker, overlap = trie.walk(words[own], sizes[own], after[own], least[low : low + WALKERS], percent)
        a, b = own[walker], inside[trie.rows[at]]
        need = -(-percent * (sizes[a] + sizes[b]) // (100 + percent))
        short = np.flatnonzero((overlap < need) & (overlap + np.minimum(rest_of[a], rest_of[b]) >= need))
        for part in np.array_split(short, max(1, len(short) >> 16)):
            n = rest_of[a[part]]
            pair = np.repeat(part, n)
            wanted = rest[np.repeat(rest_at[a[part]] - (np.cumsum(n) - n), n) + np.arange(len(pair))] % len(times) + b[pair] * len(times)
            hit = rest[np.minimum(np.searchsorted(rest, wanted), max(len(rest) - 1, 0))] == wanted
            np.add.at(overlap, pair[hit], 1)
        good = np.flatnonzero(overlap >= need)
        a, b = a[good], b[good]
        counts += np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
        # One link for each two parts that were apart until now.
        new = np.flatnonzero(label[a] != label[b])
        a, b = a[new], b[new]
        while len(a):
            x, y = int(a[0]), int(b[0])
            links.append((x, y))
            label[label == label[y]] = label[x]
            apart = np.flatnonzero(label[a] != label[b])
            a, b = a[apart], b[apart]
    return counts, links


def _text64(text_column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))


def jaccard_groups(docs: DataFrame, percent: int = 80, n: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by links),
    class_id (the smallest id with an equal set), n_links (other sets that its set is linked with)."""
    size = F.col("size") > 0
    return _grouped(docs, percent, n, id_column, text_column).select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"), F.when(size, F.col("keep.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(size, F.col("low.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _described(rows: DataFrame, n: int) -> DataFrame:
    """From rows (id, text, text64): id, text64, the class (`node`) and the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for _, found in _sets(batch.column(1), n):
                nodes.append(_key(found)), sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "text64", "node", "size"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text64 bigint, node bigint, size bigint")


def _met(rows: DataFrame, percent: int, n: int) -> DataFrame:
    """The classes (`node`) that share as many keys with others as they share with any similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple | None] = {}
        keys, nodes, infos, seen, held = [], [], [], set(), 0

        def combined() -> pa.RecordBatch:
            """Each key once, with its smallest node; then the number of keys that nodes share here.

            `info` holds band, wanted keys and, in its low bits, 0 for a key that was counted here, 1
            for one that may be met elsewhere, or the keys counted plus 1.
            """
            key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            node, info = np.array(nodes, dtype=np.int64), np.array(infos, dtype=np.int64)
            order = np.lexsort((node[owner], key))
            key, owner = key[order], owner[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            last = np.append(np.flatnonzero(first)[1:], len(key)) - 1
            several = node[owner[first]] != node[owner[last]]
            hits = np.bincount(owner[several[np.cumsum(first) - 1]], minlength=len(keys))
            counted, alone = np.flatnonzero(hits), owner[first]
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([node[counted], key[first]])), pa.array(np.concatenate([node[counted], node[alone]])), pa.array(np.concatenate([info[counted] + hits[counted] + 1, info[alone] + ~several])),
            ], names=["key", "node", "info"])

        for batch in batches:
            for _, found in _sets(batch.column(0), n):
                name = _key(found) if len(found) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                for band, wanted, own in _keys(found, percent, made):
                    keys.append(own.view(np.int64)), nodes.append(name), infos.append((band << COUNT_BITS | wanted) << COUNT_BITS)
                    held += len(own)
                if held > COMBINED:
                    yield combined()
                    keys, nodes, infos, seen, held = [], [], [], set(), 0
        if held:
            yield combined()

    entries = rows.select("text").mapInArrow(run, "key bigint, node bigint, info bigint")
    # A key has a row per block of a task at most, however many classes have it.
    bucket = Window.partitionBy("key")
    count = F.col("info").bitwiseAND((1 << COUNT_BITS) - 1)
    hits = F.when(count > 1, count - 1).when((count == 1) & (F.min("node").over(bucket) < F.max("node").over(bucket)), 1).otherwise(0)
    shared = entries.select("node", F.shiftright("info", COUNT_BITS).alias("band"), hits.alias("hits")).where("hits > 0")
    wanted = F.col("band").bitwiseAND((1 << COUNT_BITS) - 1)
    return shared.groupBy("node", "band").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= wanted).select("node").distinct()


def _looked_up(rows: DataFrame, classes: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The whole sets (node, items) of the classes of `nodes`; one may come twice, with repeated rows."""
    wanted = classes.join(nodes, "node").select("node", F.col("low.id").alias("low_id"))
    ids = wanted.select(F.col("low_id").alias("wanted_id")).distinct()
    if nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = rows.join(ids, rows["id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array([_key(found)]), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["node", "items"])

    got = texts.mapInArrow(again, "node bigint, items array<bigint>")
    return got.join(wanted.select("node"), "node", "left_semi")


def _candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of `sets` (node, items), those with a chance of a link: (node, size, items that others have
    too, in the global order), and the links (a, b) that make groups of them."""
    items = sets.select("node", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = items.join(counts, "item").groupBy("node", "size").agg(F.sort_array(F.collect_set(F.struct("n", "item"))).alias("items"))
    # Elements that no other set has come first in the order.
    first = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1 - (F.col("size") - F.size("items"))
    ordered = ordered.select("node", "size", F.col("items.item").alias("items"), first.cast("int").alias("first")).where("first > 0")
    ordered = shared_table(ordered, "jaccard-ordered")
    tokens = ordered.select("node", F.explode(F.slice("items", F.lit(1), F.col("first"))).alias("item"))
    leads = tokens.groupBy("item").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("item", "lead")
    met = tokens.join(leads, "item").where("node > lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    return ordered, met


def _links(members: DataFrame, percent: int) -> DataFrame:
    """From members (component, node, size, items): rows (a, b, n).  With a null b, n of the links of
    a; else a link.  Links connect what is connected; each pair of sets is looked at once."""
    totals = members.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("items")).alias("held"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("held") / BLOCK_ITEMS)).cast("int")
    totals = totals.where("sets > 1").select("component", blocks.alias("blocks"), "held")
    totals = shared_table(totals, "jaccard-totals")
    calls = max(1, (totals.agg(F.sum("held")).first()[0] or 0) // TOGETHER)
    dealt = members.join(totals, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    # Small groups share calls; a pair of blocks has its own.
    call = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(calls))).otherwise(F.xxhash64("component", i, j))
    dealt = dealt.select("component", "node", "size", "items", "block", i.alias("i"), j.alias("j"), call.alias("call"))

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        a, b, n = [], [], []
        for (_, i, j), rows in batch.groupby(["component", "i", "j"], sort=False):
            if len(rows) < 2:
                continue
            names = rows["node"].to_numpy()
            left = None if i == j else (rows["block"] == i).to_numpy()
            if left is not None and left.all() | ~left.any():
                continue
            counts, links = linked([np.asarray(x) for x in rows["items"]], rows["size"].to_numpy(dtype=np.int64), percent, left)
            hit = np.flatnonzero(counts)
            a += names[hit].tolist() + [int(names[x]) for x, _ in links]
            b += [None] * len(hit) + [int(names[y]) for _, y in links]
            n += counts[hit].tolist() + [0] * len(links)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(n, "Int64")})

    return dealt.groupBy("call").applyInPandas(join, "a bigint, b bigint, n bigint")


def _grouped(docs: DataFrame, percent: int, n: int, id_column: str, text_column: str) -> DataFrame:
    """One row per row of `docs`: id, text64, size, `low`, the first (no_id, id, text64) of the class,
    `keep`, that of the component, and n_links; the last three are null for an empty set.  Any id
    comes before a null one."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), _text64(text_column).alias("text64"))
    found = shared_table(_described(rows, n), "jaccard-rows")
    lows = found.where("size > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text64")).alias("low"))
    classes = shared_table(lows, "jaccard-classes")
    met = shared_table(_met(rows, percent, n), "jaccard-met")
    drop_shuffles(docs.sparkSession)
    sets = shared_table(_looked_up(rows, classes, met, n), "jaccard-sets")
    ordered, candidates = _candidates(sets, percent)
    drop_table(sets)
    drop_shuffles(docs.sparkSession)
    groups = shared_table(components(candidates), "jaccard-groups")
    links = shared_table(_links(ordered.join(groups, "node").select("component", "node", "size", "items"), percent), "jaccard-links")
    grouped = components(links.where("b IS NOT NULL").select("a", "b"))
    counted = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = classes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Only components of several classes need their smallest id; the others are their own.
    lowest = named.groupBy("component").agg(F.min("low").alias("keep"), F.count(F.lit(1)).alias("several")).where("several > 1").select("component", "keep")
    named = named.join(lowest, "component", "left").join(counted, "node", "left").select("node", "low", F.coalesce("keep", "low").alias("keep"), "n_links")
    named = shared_table(named, "jaccard-named")
    for spent in (met, ordered, groups, links, classes):
        drop_table(spent)
    return found.join(named, "node", "left").select("id", "text64", "size", "low", "keep", "n_links")


def keep_one_of_each(docs: DataFrame, percent: int = 80, n: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one row of each component, the one with the smallest id; columns as they are.

    Rows are told apart by id and text, a null id ranking last; of rows equal in both, the one whose
    other columns come first in their JSON form stays.  Rows without words are in no component and
    stay.
    """
    same = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("text64") == F.col("keep.text64"))
    groups = _grouped(docs, percent, n, id_column, text_column).where("size > 0").groupBy("id", "text64", "keep").agg(F.count(F.lit(1)).alias("copies"))
    changed = groups.withColumn("stays", same).where(~F.col("stays") | (F.col("copies") > 1))
    changed = shared_table(changed.select(F.col("id").alias("changed_id"), F.col("text64").alias("changed_text"), "stays"), "jaccard-changed")
    # The row travels whole, so that no column of `docs` can clash with the names used here.
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    held = docs.select(row.alias("row"), F.col(f"`{id_column}`").alias("id"), _text64(text_column).alias("text64"))
    back = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    at = held["id"].eqNullSafe(changed["changed_id"]) & (held["text64"] == changed["changed_text"])
    kept = held.join(changed, at, "left_anti").select(*back)
    repeated = changed.where("stays")
    if repeated.isEmpty():
        return kept
    ones = held.join(repeated, at, "left_semi").groupBy("id", "text64").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(ones.select(*back))


ship_by_value(__name__)
