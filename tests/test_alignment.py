"""One-to-one alignment against going through the gold items one by one."""

import random
from collections import Counter

from brindle.operators.alignment import aligned, confusion

BY = {"span": 3, "topic": 2, "key": 1}


def _one_by_one(gold, predicted):
    out = []
    for case in {g["case_id"] for g in gold}:
        free = sorted((p for p in predicted if p["case_id"] == case), key=lambda p: p["at"])
        for g in sorted((g for g in gold if g["case_id"] == case), key=lambda g: g["at"]):
            scored = [(max((s for c, s in BY.items() if g[c] and g[c] == p[c]), default=0), -i) for i, p in enumerate(free)]
            if scored and max(scored)[0] > 0:
                score, i = max(scored)
                out.append((case, g["at"], free.pop(-i)["at"], score))
    return sorted(out)


def test_alignment(spark):
    rng = random.Random(4)
    item = lambda case, at: dict(case_id=case, at=at, span=rng.choice(["a", "b", "c", "", None]), topic=rng.choice(["t", "u", None]), key=rng.choice(["k", "l", "m"]), kind=rng.choice(["task", "event"]))
    gold = [item(c, i) for c in range(6) for i in range(rng.randrange(6))] + [item(9, 0)]
    predicted = [item(c, i) for c in range(6) for i in range(rng.randrange(7))]
    schema = "case_id int, at int, span string, topic string, key string, kind string"
    frame = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    pairs = aligned(frame(gold), frame(predicted), "case_id", "at", BY)
    want = _one_by_one(gold, predicted)
    assert sorted(tuple(r) for r in pairs.select("case", "gold", "predicted", "score").collect()) == want and len(want) > 5
    kinds = {(g["case_id"], g["at"]): g["kind"] for g in gold}, {(p["case_id"], p["at"]): p["kind"] for p in predicted}
    counts = Counter((kinds[0][c, g], kinds[1][c, p]) for c, g, p, _ in want)
    counts.update((k, None) for (c, a), k in kinds[0].items() if not any(w[0] == c and w[1] == a for w in want))
    counts.update((None, k) for (c, a), k in kinds[1].items() if not any(w[0] == c and w[2] == a for w in want))
    assert {(r["gold_kind"], r["predicted_kind"]): r["n"] for r in confusion(pairs, frame(gold), frame(predicted), "case_id", "at", "kind").collect()} == counts
    assert aligned(frame(gold).limit(0), frame(predicted), "case_id", "at", BY).count() == 0
