"""Memories for candidates by groups, against a comparison of all pairs, and the rows that joins make."""

import json
import random

from brindle.operators import hybrid
from tests.plans import join_rows

MEMORY = "id long, memory_type string, memory_key string, content string, subject string, predicate string, object_value string, scope string, updated_at long"
ASKED = "candidate_id long, memory_type string, memory_key string, subject string, predicate string, object_value string, entities array<string>, scope string"
WEIGHTS = {"exact": 1.6, "structured": 1.35, "family": 1.2}


def _plain(text):
    return "".join(ch for ch in (text or "").lower() if ch.isalnum())


def _pairs(asked, memories, top):
    """The same lists from all pairs."""
    n, out = max(30, 3 * top), []
    for c in asked:
        mine = [m for m in memories if m["memory_type"] is not None and m["memory_type"] == c["memory_type"]]
        key = lambda m: c["memory_key"] is not None and m["memory_key"] == c["memory_key"]  # noqa: E731, B023
        low = lambda x: None if x is None else x.lower()

        def slot(m):
            generic = c["memory_type"] == "preference" and _plain(c["predicate"]) == "preference"  # noqa: B023
            if c["predicate"] and not generic and low(m["predicate"]) == low(c["predicate"]):  # noqa: B023
                return True
            if c["object_value"] and m["object_value"] is not None and c["object_value"][:120].lower() in m["object_value"].lower():  # noqa: B023
                return True
            return any(e is not None and e[:120].lower() in (m["content"] or "").lower() for e in (c["entities"] or [])[:5])  # noqa: B023

        def family(m):
            f = f"{c['memory_type']}_family_key"  # noqa: B023
            return c["memory_type"] in ("task", "preference") and (a := json.loads(c["scope"] or "{}").get(f)) is not None and a == json.loads(m["scope"] or "{}").get(f)  # noqa: B023

        lists = [("exact", key, 20, False), ("structured", slot, n, True), ("family", family, min(20, n), False), ("structured", lambda m: c["memory_type"] == "task", n, False)]  # noqa: B023
        score, seen = {}, {}
        for name, test, length, leads in lists:
            ranked = sorted([m for m in mine if test(m)], key=lambda m: (leads and key(m), m["updated_at"], m["id"]), reverse=True)[:length]  # noqa: B023
            for i, m in enumerate(ranked, 1):
                score[m["id"]] = score.get(m["id"], 0.0) + WEIGHTS[name] / (60 + i)
                seen.setdefault(m["id"], set()).add(name)
        by = {m["id"]: m for m in memories}
        final = {}
        for i, s in score.items():
            same = lambda f: 0.03 if c[f] and _plain(c[f]) == _plain(by[i][f]) else 0.0  # noqa: E731, B023
            final[i] = round(round(s, 6) + (0.08 if key(by[i]) else 0.0) + same("subject") + same("predicate"), 6)
        best = sorted(final, key=lambda i: (final[i], by[i]["updated_at"], i), reverse=True)[:top]
        out += [(c["candidate_id"], i, final[i], len(seen[i]), r) for r, i in enumerate(best, 1)]
    return sorted(out)


def _rows(rng, n):
    words = ["Tea", "tea house", "green tea house by", "x", "", "路边咖啡", "咖啡", "a.b", "Green Tea"]
    kinds = ["task", "preference", "semantic", "preference", None]
    pick = lambda: rng.choice([None, *words])
    scope = lambda: rng.choice([None, json.dumps({f"{rng.choice(['task', 'preference'])}_family_key": f"f{rng.randrange(3)}"})])
    return [
        dict(memory_type=rng.choice(kinds), memory_key=rng.choice([None, "k1", "k2", "k3"]), subject=pick(), predicate=rng.choice([None, "", "Likes", "likes", "Preference", "drinks"]), object_value=pick(), scope=scope(), content=pick())
        for _ in range(n)
    ]


def test_groups_equal_pairs(spark):
    rng = random.Random(5)
    memories = [{**r, "id": i, "updated_at": rng.randrange(100)} for i, r in enumerate(_rows(rng, 400))]
    asked = [{**{k: v for k, v in r.items() if k != "content"}, "candidate_id": i, "entities": rng.choice([None, [], ["tea", None], ["x", "咖啡"], ["green tea house b"], ["", "q"]])} for i, r in enumerate(_rows(rng, 60))]
    found = hybrid.slot_channels(spark.createDataFrame(asked, ASKED), spark.createDataFrame(memories, MEMORY), 12).select("candidate_id", "id", "score", "channels", "rank")
    assert sorted(map(tuple, found.collect())) == _pairs(asked, memories, 12)


def test_candidates_and_memories_are_not_paired(spark):
    """Joins put out what the lists hold, not candidates times memories of a type."""
    n = 3000
    memories = spark.range(n).selectExpr("id", "'preference' AS memory_type", "concat('k', id) AS memory_key", "'x' AS content", "'s' AS subject", "concat('p', id % 50) AS predicate", "CAST(NULL AS STRING) AS object_value", "CAST(NULL AS STRING) AS scope", "id AS updated_at")
    asked = memories.selectExpr("id AS candidate_id", "memory_type", "memory_key", "subject", "predicate", "object_value", "CAST(NULL AS ARRAY<STRING>) AS entities", "scope")
    rows, most = join_rows(hybrid.slot_channels(asked, memories, 10).groupBy("candidate_id").count())
    assert len(rows) == n and all(count == 10 for _, count in rows)
    assert most <= 40 * n
