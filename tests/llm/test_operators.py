"""Corpus operators against brute force on small fixtures: nulls, empties, ties, repeats, long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat_format, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, quality_model, quality_rules, sentence_pieces, sharding
from brindle.llm.queries import ORACLE_SQL, PIECE_MODEL, QUERIES
from tests.oracle import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
ROWS = [
    (1, "The same text of five words", "en", "a", 27, "x"), (2, "The same text of five words", "en", "a", 27, "x"), (2, "The same text of five words", "en", "a", 27, "x"), (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "y"), (None, "no id here at all", "de", "b", 17, None), (5, LONG, "en", "b", len(LONG), "z"), (6, LONG + " tail", "en", "b", len(LONG) + 5, "z"), (7, "日本 語 ▁ \x00 é\n  ", "ja", "c", 12, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("hash_hex", [32, 1])
def test_exact_dedup(docs, hash_hex):
    found = exact_dedup.exact_groups(docs, hash_hex=hash_hex).collect()
    assert len(found) == len(ROWS)
    texts = Counter((r[1] or "") for r in ROWS)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert all(r["group_size"] == texts[digest[r["text_sha256"]]] for r in found)
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(digest, 1))
    assert {r["keep_id"] for r in found if r["group_size"] == 3} == {2}


def test_keep_one_keeps_columns(docs, empty):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[1] or "" for r in ROWS})
    assert exact_dedup.keep_one(empty).count() == 0


def _jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, empty):
    found = sharding.shard_rows(docs, 3).collect()
    assert len(found) == len(ROWS)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["shard"], r["grown_shard"]) == (_jump(r["doc_id"], 3), _jump(r["doc_id"], 4))
    by_shard = Counter(r["shard"] for r in found)
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n)) for s, n in by_shard.items())
    assert Counter((r["size"], r["text_crc32"]) for r in found) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sharding.shard_rows(empty, 3).count() == 0


def test_chat_fold_and_round_trip(spark, empty):
    texts = ["\\### Assistant: </turn> ok", "a\\e\\\\h###</turn>", "", None, "####</turn></turn>\n### User: x"]
    log = [(1, i, None, "message", r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "User", "a: b", None], texts))]
    log += [(2, 0, 9, "message", "assistant", "draft"), (2, 1, 9, "regenerate", "assistant", None), (2, 2, 9, "delta", "assistant", "new "), (2, 3, 9, "delta", "assistant", "text"), (2, 4, 8, "message", "user", "old"), (2, 5, 8, "edit", "user", "fixed")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(events)).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [(r or "", t or "") for r, t in zip(["user", "assistant", "User", "a: b", None], texts)]
    assert found[1]["loss_texts"] == [texts[1]]
    assert [(t["role"], t["text"]) for t in found[2]["turns"]] == [("assistant", "new text"), ("user", "fixed")]
    assert chat_format.format_chats(events.limit(0)).count() == 0


def test_quality_rules(docs, empty):
    found = quality_rules.judged(docs).collect()
    assert len(found) == len(ROWS)
    by_text = {zlib.crc32((t or "").encode()): t or "" for _, t, *_ in ROWS}
    counts = Counter((r["n_words"], r["word_chars"]) for r in found)
    assert counts == Counter((len(WORD.findall(t or "")), sum(map(len, WORD.findall(t or "")))) for _, t, *_ in ROWS)
    assert by_text and quality_rules.keep_passed(docs).columns == docs.columns
    assert quality_rules.judged(empty).count() == 0


def test_repeated_words(spark):
    base = [f"w{i}" for i in range(30)]
    for words in (base + base[3:15], base, base[:8] * 3, ["x"] * 40):
        n = len(words)
        seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        covered = {j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        frame = spark.createDataFrame([(1, " ".join(words), "h")], "doc_id long, text string, source string")
        assert quality_rules.judged(frame).first()["n_repeat_words"] == len(covered)


def test_common_lines_leave_one_carrier(spark):
    own = lambda i: " ".join(f"u{i}w{j}" for j in range(30))
    line = " ".join(f"common{j}" for j in range(25))
    rows = [(i, line if i < 8 else f"{line}\n{own(i)}", "h") for i in range(20)]
    rows = [(i, f"{t} {i}" if i < 0 else t, s) for i, t, s in rows]
    found = {r["id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[0]["kept"] and found[0]["removed_words"] == 0
    assert all(found[i]["kept"] for i in range(8, 20)) and all(not found[i]["kept"] for i in range(1, 8))


def test_common_lines_leave_the_texts(spark):
    schema = "doc_id long, text string, source string, n_chars long"
    own = lambda i: " ".join(f"u{i}w{j}" for j in range(30))
    line, shown = " ".join(f"common{j}" for j in range(25)), lambda i: f"  First {own(i)}\r\n\n\tCommon0   " + " ".join(f"COMMON{j}" for j in range(1, 25)) + f"\r\nlast\t{own(1000 + i)}\n"
    rows = [(i, line if i < 8 else shown(i), "h", -1) for i in range(1, 20)] + [(None, shown(50), "h", -1), (20, shown(20), "h", -1), (20, shown(20), "h", -1), (1, shown(60), None, -1), (30, None, "h", None)]
    rows += [(100 + i, own(100 + i), "h", -1) for i in range(3)] + [(0, shown(70) + line, "h", -1)]
    frame = spark.createDataFrame(rows, schema)
    found = Counter(tuple(r) for r in quality_rules.clean(frame, length_column="n_chars").collect())
    without = lambda t: "\n".join(x for x in t.split("\n") if " ".join(x.lower().split()) != line)
    expected = Counter()
    for i, t, h, n in rows:
        if t is None or (t == line):
            continue
        left = t if h is None or i == 0 else without(t)
        expected[(i, left, h, n if left == t else len(left))] += 1
    assert found == expected and any(len(k[1]) == k[3] for k in found)
    assert quality_rules.clean(frame).columns == frame.columns and quality_rules.clean(frame.limit(0)).count() == 0


def test_line_limit_does_not_grow_with_the_host(spark):
    own = lambda i: " ".join(f"u{i}w{j}" for j in range(30))
    line = "the same notice under every text"
    rows = [(i, f"{own(i)}\n{line}" if i < 8 else own(i), "h") for i in range(200)]
    found = {r["doc_id"]: r["text"] for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {i: t if i == 0 else own(i) for i, t, _ in rows}


def _components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5), (80, 1)])
def test_jaccard_groups(spark, percent, n):
    rng = np.random.default_rng(5)
    rows, word = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two")], lambda: f"v{rng.integers(4000)}"
    for size in (4, 9, 14, 40, 130, 600):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 12)))):
                copy[int(rng.integers(size))] = word()
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.5 else base
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame, percent, n).collect()}
    assert found == _components(rows, n, percent)


def test_jaccard_edges(docs, empty):
    assert jaccard_join.jaccard_groups(docs).count() == len(ROWS)
    assert jaccard_join.keep_one_of_each(docs).columns == docs.columns
    assert jaccard_join.jaccard_groups(empty).count() == 0


def test_keep_one_of_each_row(spark):
    schema = "doc_id long, text string, source string"
    text = lambda x: " ".join(f"{x}{j}" for j in range(200))
    rows = [
        (4, text("a"), "s"), (None, text("a") + " tail", "s"), (None, text("b"), "s"), (None, text("c"), "s"), (None, text("c") + " tail", "s"),
        (7, text("d"), "s"), (7, text("d") + " tail", "s"), (7, text("e"), "s"), (8, text("f"), "t"), (8, text("f"), "s"), (8, text("f"), "s"), (9, text("f") + " tail", "s"),
        (None, None, "s"), (None, "", "s"), (3, "", "s"), (5, " ", "s"),
    ]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    begins = Counter((r["text"] or "").strip()[:2] for r in kept)
    assert begins == {"a0": 1, "b0": 1, "c0": 1, "d0": 1, "e0": 1, "f0": 1, "": 4}
    assert {(r["doc_id"], r["source"]) for r in kept if (r["text"] or "").startswith(("a", "f"))} == {(4, "s"), (8, "s")}


def test_language_id(docs, empty):
    model = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == "und" and found[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify(docs, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op5_language_id"](spark, sf_dir).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert found > 0.9


def test_quality_model(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(quality_model.labelled_sample(docs, labels))
    scores = quality_model.score(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    none = quality_model.fit(quality_model.labelled_sample(empty, labels))
    assert {r["score"] for r in quality_model.score(docs, none).collect()} == {0.5}
    # The sum-of-squares form equals the sum over pairs.
    rng = np.random.default_rng(1)
    bucket, value, cut, numbers = np.array([3, 7, 9]), rng.random(3), np.array([0, 3]), rng.random((1, quality_model.N_DENSE))
    m = quality_model.Machine(0.1, rng.random(quality_model.BUCKETS + quality_model.N_DENSE), rng.random((quality_model.BUCKETS + quality_model.N_DENSE, 8)), numbers[0], numbers[0])
    x = {**dict(zip(bucket, value)), **{quality_model.BUCKETS + i: v for i, v in enumerate(numbers[0])}}
    keys = list(x)
    direct = 0.1 + sum(m.weights[k] * x[k] for k in keys) + sum(m.factors[a] @ m.factors[b] * x[a] * x[b] for i, a in enumerate(keys) for b in keys[i + 1 :])
    assert quality_model._raw_scores(m, bucket, value, cut, numbers)[0][0] == pytest.approx(direct)


def test_lm_scores(docs, spark):
    rows = [r for r in lm_scoring.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1).collect()]
    fold = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + [None]
    counts = Counter(w for i, t, *_ in ROWS if (i or 0) % 2 == 1 for w in fold(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(fold(t)), sum(w in counts for w in fold(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in fold(t)), 6)) for _, t, *_ in ROWS)
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_forward_equals_the_sum_over_paths():
    import itertools

    rng = np.random.default_rng(2)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((4, 3))
    hmm = lm_scoring.Hmm(start, move, emit)
    seqs = [[0, 1, 3], [2, 3], [3]]
    flat, cut = np.array([x for s in seqs for x in s]), np.array([0, 3, 5, 6])
    logs, _, _ = lm_scoring._forward(hmm, lm_scoring._Lanes(flat, cut), keep=False)
    for log, seq in zip(logs, seqs):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seq)):
            p = start[path[0]] * emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= move[a, b] * emit[s, b]
            total += p
        assert log == pytest.approx(math.log(total))


def test_mixing_keeps_columns_and_budget(spark, docs, empty):
    targets = mixing.Targets({"d": 1.0}, {}, {}, share=0.5, max_epochs=2)
    found = mixing.mix(docs, F.lit("d"), targets)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert found.agg(F.sum("mix_tokens")).first()[0] <= 0.5 * sum(len(WORD.findall(r[1] or "")) for r in ROWS) + 1
    assert mixing.mix(empty, F.lit("d"), targets).count() == 0


def test_pieces_round_trip_and_chunks_agree(docs, empty):
    whole = sentence_pieces.encode(docs, PIECE_MODEL, check=True)
    assert whole.where("NOT round_trip").count() == 0 and whole.count() == len(ROWS)
    # Texts of several segments give the ids of texts that are one segment; 90 of them make a tree of two levels.
    chunked = sentence_pieces.encode(docs.where("doc_id > 4"), PIECE_MODEL, segment=1, check=True)
    assert chunked.where("NOT round_trip").count() == 0
    same = chunked.drop("round_trip").withColumnRenamed("token_ids", "other").join(whole.select("doc_id", "token_ids"), "doc_id")
    assert same.where("other <> token_ids").count() == 0 and same.count() == 3
    assert sentence_pieces.decode(whole, PIECE_MODEL).where("doc_id = 7").first()["text"] == ROWS[-1][1]
    assert sentence_pieces.encode(empty, PIECE_MODEL).count() == 0


def _best_segmentation(pieces, ids, text):
    best, back = [0] + [None] * len(text), [0] * (len(text) + 1)
    for at in range(len(text)):
        found = [(n, int(pieces.scores[ids[text[at : at + n]]])) for n in range(1, min(pieces.longest, len(text) - at) + 1) if text[at : at + n] in ids]
        if not found or found[0][0] != 1:
            found.insert(0, (1, pieces.unknown))
        for n, gain in found:
            if best[at + n] is None or best[at] + gain > best[at + n]:
                best[at + n], back[at + n] = best[at] + gain, n
    out, at = [], len(text)
    while at:
        piece = text[at - back[at] : at]
        out.append([ids[piece]] if piece in ids else [int(pieces.byte_ids[b]) for b in piece.encode()])
        at -= back[at]
    return [i for x in reversed(out) for i in x]


def test_pieces_equal_the_best_segmentation(spark, sf_dir):
    pieces = sentence_pieces._Pieces(sentence_pieces.piece_table(PIECE_MODEL))
    ids = {b.decode(): i for i, b in enumerate(pieces.bytes) if pieces.scores[i] < 0}
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts += [r[1] or "" for r in ROWS if r[0] != 6] + ["a" * 3000, "日" * 1500, " " * 2000, "ab" * 1000 + "日本語" * 400, "é\U0001f600" * 300]
    want = {i: _best_segmentation(pieces, ids, " " + t if t else "") for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for segment in (64, 2):
        assert {r["id"]: r["token_ids"] for r in sentence_pieces.encode(frame, PIECE_MODEL, segment=segment).collect()} == want


def test_max_plus_scan_equals_products_in_order():
    rng = np.random.default_rng(3)
    matrices, entry = rng.integers(-50, 0, (2, 8, 3, 3)), rng.integers(-50, 0, (2, 3))
    before, whole = sentence_pieces.scan(entry, matrices)
    for r in range(2):
        state = entry[r]
        for k in range(8):
            assert (before[r, k] == state).all()
            state = (state[:, None] + matrices[r, k]).max(axis=0)
        assert (state == (entry[r][:, None] + whole[r]).max(axis=0)).all()


def test_columns_of_any_name(spark, docs):
    """Columns named as those that the operators use inside stay as they are, or are replaced where documented."""
    names = ["quality", "label", "id", "row", "text64", "changed_id", "hash", "body", "mix_epoch", "mix_domain", "mix_tokens", "mix_budget", "tokens", "token_ids", "round_trip", "n_tokens", "k", "node", "keep", "size", "a.b", "shard", "host"]
    more = docs.withColumns({n: F.lit(f"of {n}") for n in names}).withColumn("map", F.create_map(F.lit("x"), F.lit(1)))
    kept = exact_dedup.keep_one(more)
    assert kept.columns == more.columns and {r["a.b"] for r in kept.collect()} == {"of a.b"} and kept.first()["map"] == {"x": 1}
    assert jaccard_join.keep_one_of_each(more).columns == more.columns
    assert jaccard_join.jaccard_groups(more).count() == len(ROWS) and sharding.shard_rows(more, 4).count() == len(ROWS)
    cleaned = quality_rules.clean(more, length_column="n_chars")
    assert cleaned.columns == more.columns and quality_rules.keep_passed(more).count() == cleaned.count()
    mixed = mixing.mix(more, F.lit("d"), mixing.Targets({"d": 1.0}, {}, {}))
    assert sorted(mixed.columns) == sorted(more.columns) and {r["tokens"] for r in mixed.collect()} <= {"of tokens"}
    coded = sentence_pieces.encode(more, PIECE_MODEL, check=True)
    assert sorted(coded.columns) == sorted(set(more.columns) - {"text"}) and coded.where("NOT round_trip").count() == 0
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    model = quality_model.fit(quality_model.labelled_sample(more, labels))
    assert quality_model.score(more, model).count() == language_id.identify(more, language_id.train(more)).count() == len(ROWS)
    assert lm_scoring.score(more, F.col("doc_id") > 1).count() == len(ROWS)


def test_labelled_sample_is_bounded(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 1), (5, None), (None, 1)], "doc_id long, quality int")
    repeated = docs.unionByName(docs).unionByName(docs)
    assert quality_model.labelled_sample(repeated, labels, max_rows=5).count() == 2
    assert quality_model.labelled_sample(repeated, labels, max_rows=1).count() == 1


def test_held_out_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"]).dropna()
    rows = QUERIES["op2_quality_model"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_expected_counts_equal_the_sum_over_paths():
    import itertools

    rng = np.random.default_rng(4)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    hmm = lm_scoring.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))).T)
    seqs = [[0, 1, 3], [2, 3], [1, 1, 0, 3]]
    first, moves, symbols = lm_scoring._expected(hmm, lm_scoring._Lanes(np.concatenate(seqs), np.array([0, 3, 5, 9])))
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for seq in seqs:
        paths = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = hmm.start[path[0]] * hmm.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= hmm.move[a, b] * hmm.emit[s, b]
            paths[path] = p
        for path, p in paths.items():
            share = p / sum(paths.values())
            want[0][path[0]] += share
            for a, b in zip(path, path[1:]):
                want[1][a, b] += share
            for a, s in zip(path, seq):
                want[2][s, a] += share
    for x, y in zip((first, moves, symbols), want):
        assert x == pytest.approx(y)


def test_chat_fold_against_replay(spark):
    """Random logs of messages, deltas, edits and regenerations, against a replay in order."""
    rng = np.random.default_rng(9)
    log = []
    for conv in range(12):
        for seq in range(int(rng.integers(1, 25))):
            kind = ["message", "delta", "delta", "edit", "regenerate"][int(rng.integers(5))]
            log.append((conv, seq, int(rng.integers(4)), kind, ["user", "assistant"][int(rng.integers(2))], f"<{seq}>" if rng.random() < 0.9 else None))
    want: dict = {}
    for conv, _, message, kind, role, text in log:
        chat = want.setdefault(conv, {})
        own = chat.setdefault(message, [role, ""])
        own[1] = own[1] + (text or "") if kind == "delta" else "" if kind == "regenerate" else (text or "")
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string").repartition(5)
    found = {r["conv_id"]: [[t["role"], t["text"]] for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(events)).collect()}
    assert found == {c: list(chat.values()) for c, chat in want.items()}


def test_links_are_counted(spark):
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(60))] = f"x{rng.integers(50)}"
        rows.append((i, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(frozenset(tuple(w[k : k + 2]) for k in range(59)), []).append(i)
    links = {s: sum(s is not o and 100 * len(s & o) >= 85 * len(s | o) for o in sets) for s in sets}
    want = {i: (min(ids), links[s]) for s, ids in sets.items() for i in ids}
    found = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, n=2).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == want and max(x for _, x in want.values()) > 3


@pytest.mark.parametrize("percent", [50, 90])
def test_groups_beyond_a_block(spark, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard_join, "WALKERS", 3)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(45):
        words = [f"v{j}" for j in range(30)]
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(30))] = f"y{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent, 1).collect()}
    assert found == _components(rows, 1, percent)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The Python queries run where only the driver can import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from brindle.llm.queries import QUERIES
for name in ("op2_quality_model", "op3_lm_scoring", "op4_jaccard_join", "op5_language_id", "op8_sentence_pieces"):
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept.count(), stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns and kept.count() <= before, name
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and len({seen[i] for i in ids}) == len(ids)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(i == c for i, (_, c) in _components(list(texts.items()), 5, 80).items())
    # The mix of what is left, against the SQL of the operator on these rows.
    import duckdb

    duck = duckdb.connect()
    documents = kept.select("doc_id", "text", "lang", "source").toPandas()
    duck.register("documents", documents)
    want = Counter(r[0] for r in duck.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op10_mixing']})").fetchall())
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, sf_dir).cache()
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == want and len(want) > 10
    # Tokens: the best segmentation of each text, decoded to the text.
    coded = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir)
    assert coded.count() == mixed.count() and "text" not in coded.columns
    back = {r["doc_id"]: (r["text"], r["n_tokens"], r["token_ids"]) for r in sentence_pieces.decode(coded, PIECE_MODEL).collect()}
    assert {i: t for i, (t, _, _) in back.items()} == {i: texts[i] or "" for i in want}
    pieces = sentence_pieces._Pieces(sentence_pieces.piece_table(PIECE_MODEL))
    known = {b.decode(): i for i, b in enumerate(pieces.bytes) if pieces.scores[i] < 0}
    for i in sorted(want)[:15]:
        assert back[i][2] == _best_segmentation(pieces, known, " " + texts[i]) and back[i][1] == len(back[i][2])
