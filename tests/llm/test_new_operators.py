"""Clustering, prefix trie and byte pairs against brute force: nulls, empties, ties, repeats, long inputs."""

import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from brindle.llm import byte_pairs, centroids, language_id, prefix_trie
from brindle.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _clusters(rows, k=16, dims=64, scale=64, rounds=3):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def deal():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = deal()
        for j in range(len(cents)):
            own = [v for (_, v), (c, _) in zip(kept, got) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    got = deal()
    fits = lambda x: x if x < 1 << 63 else None
    by = defaultdict(int)
    for c, d in got:
        by[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, fits(d), fits(by[c]), fits(sum(by.values())), sha[c]) for (i, _), (c, d) in zip(kept, got)), key=str)


def _found_clusters(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, cluster int")
    got = centroids.cluster(frame, **how).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_clusters_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_centroid_clustering"](spark, sf_dir).collect()), key=str)
    assert got == _clusters(rows) and len({r[1] for r in got}) > 4


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(60)]
    rows += [(1, [0.5, 0.5, 0.5, 0.5])] * 5 + [(None, [1.0, 2.0, 3.0, 4.0]), (70, None), (71, [1.0]), (72, [1.0, None, 1.0, 1.0]), (73, [math.nan, 0.0, 0.0, 0.0]), (74, [math.inf, 0.0, 0.0, 0.0])]
    for extra in ([], [(80, [1e6, -1e6, 0.0, 0.3]), (81, [2e6, -1e6, 0.0, 0.3])], [(82, [3e8, 1.0, 1.0, 1.0])], [(83, [1e300, 0.0, -1e300, 1.0]), (84, [1.7e308, 0.0, 0.0, 1.0])]):
        assert _found_clusters(spark, rows + extra, k=5, dims=4, scale=64, rounds=3) == _clusters(rows + extra, 5, 4)
    assert _found_clusters(spark, rows[:3], k=5, dims=4) == _clusters(rows[:3], 5, 4)
    assert _found_clusters(spark, [(1, None)], dims=4) == []


def _trie(rows):
    """Every node from every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + x[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
        term = (len(members[p]) - 1) * len(regex.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += term
    for p in members:
        if not children[p]:
            for d in range(len(p) + 1):
                leaves[p[:d]] += 1
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def _found_trie(spark, rows, pieces=None):
    frame = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)
    got = prefix_trie.prefix_trie(frame).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture(params=[1, 7, 40])
def many_partitions(spark, request):
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_of_small_alphabet(spark, many_partitions):
    rng = random.Random(many_partitions)
    rows = []
    for c in range(-25, 200):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * (1 if c % 3 else 7), t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(["a", "a", "a b", "", None])))
    rows += [(5000, i, "user", "long turn") for i in range(700)] + [(5020, i, "user", "long turn") for i in range(650)] + [(6000 + i, 0, "user", "same") for i in range(120)] + [(None, 0, "user", "no id")] * 3
    assert _found_trie(spark, rows) == _trie(rows)


def test_trie_of_copies(spark, many_partitions):
    same = [("user", "hello there"), ("assistant", "hi"), ("user", "and so on")]
    rows = [(20 * c, t, *x) for c in range(150) for t, x in enumerate(same)]
    rows += [(20 * c, t, *x) for c in range(150, 170) for t, x in enumerate(same[: c % 3 + 1])] + [(20 * c, t, *x) for c in range(170, 190) for t, x in enumerate([*same, ("user", str(c % 4))])]
    assert _found_trie(spark, rows) == _trie(rows)


def test_trie_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, sf_dir).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)
    assert got == _trie(rows)
    assert _found_trie(spark, []) == []


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark):
    rng = random.Random(3)
    _, encoding = _reference()
    texts = [None, "", " ", "The same text", "the same text", "日本 語 ▁ \x00 é\n  ", "<|endoftext|> x", "a" * 30000, "ab" * 9000, " " * 5000 + "x", "\r\n\t\x0b\x85 "]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3040, 0x30FF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(400)) for _ in range(20)]
    texts += [" ".join(f"w{i % 977}x{i % 31}" for i in range(9000))]
    rows = [(i % 25, t, "other", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded string")
    coded = byte_pairs.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "decoded", "token_ids"]
    want = sorted((i, encoding.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["token_ids"]) for r in coded.collect()) == want
    packed = byte_pairs.encode(docs, RANKS, public_tokenizers.PATTERN, packed=True)
    assert sorted((r["doc_id"], np.frombuffer(r["token_ids"], "<u4").tolist()) for r in packed.collect()) == want
    for frame in (coded, packed):
        assert sorted((r["doc_id"], bytes(r["decoded"])) for r in byte_pairs.decode(frame, RANKS).collect()) == sorted((i, (t or "").encode()) for i, t, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, [10**8]), (3, [])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in byte_pairs.decode(odd, RANKS).collect()} == {1: b"", 2: None, 3: b""}
    assert byte_pairs.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def _one_by_one(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_byte_pairs_of_any_ranks():
    """Ranks in an order that no training gives: merges then make pairs below their own rank."""
    rng = random.Random(11)
    for _ in range(60):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 60))}
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(sorted(words, key=lambda _: rng.random()))}
        merger = byte_pairs.Merger(byte_pairs.merge_table(ranks))
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(20)]
        ids, counts = merger.merged(pieces)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [_one_by_one(ranks, p) for p in pieces]
        assert [merger.one_by_one(p) for p in pieces] == got


def test_rank_queue():
    queue, rng = byte_pairs.RankQueue(50256), random.Random(2)
    held = {rng.randrange(50256) for _ in range(500)}
    for r in held:
        queue.bucket(r).append(r)
    out = []
    while (r := queue.first()) >= 0:
        assert queue.take(r) == [r]
        out.append(r)
        if len(out) == 50:
            queue.bucket(3).append(3)
    assert out == [*sorted(held)[:50], 3, *sorted(held)[50:]]


def test_byte_pairs_of_the_table(spark, sf_dir):
    _, encoding = _reference()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_byte_pairs"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4")
        want = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_languages_by_brute_force(spark):
    """Counts, smoothing, posterior and score worked out n-gram by n-gram."""
    rng = random.Random(8)
    sounds = {"aa": "abcde ", "bb": "cdefgh ", "cc": "éèçab "}
    make = lambda lang, n: "".join(rng.choice(sounds[lang]) for _ in range(n))
    learnt = [(i, make(lang, rng.randrange(5, 90)), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 6)] + [(90, None, "aa"), (91, "xyz", None)]
    asked = [(i, make(rng.choice(list(sounds)), n)) for i, n in enumerate([1, 2, 5, 30, 300, 9000])] + [(50, "123 !?"), (51, None), (52, "ÉA"), (53, "")]

    def grams(text):
        padded = f" {text.lower()} "
        for k, n in enumerate(language_id.LENGTHS):
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                yield k, (h * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % language_id.BUCKETS

    counts, totals, rows = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, lang in learnt:
        if text is not None and lang is not None:
            rows[lang] += 1
            for k, b in grams(text):
                counts[lang, k, b] += 1
                totals[lang, k] += 1
    model = language_id.train(spark.createDataFrame(learnt, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        if text is None or not any(c.isalpha() for c in text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        every = list(grams(text))
        logs = {lang: math.log(n / sum(rows.values())) + sum(math.log((counts[lang, k, b] + 0.5) / (totals[lang, k] + 0.5 * language_id.BUCKETS)) for k, b in every) for lang, n in rows.items()}
        best = max(sorted(logs), key=logs.get)
        score = 1 / sum(math.exp((x - logs[best]) / len(every)) for x in logs.values())
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - score) < 1e-4
