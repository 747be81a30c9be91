"""Projections against a replay that holds everything in dictionaries; revisions, races and ages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import projection as P

FACTS = "space string, facet string, id long, content string, importance double, confidence double, updated_at timestamp"


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def _lit(minute):
    return F.to_timestamp(F.lit(str(_at(minute))))


def _state(spark, rows=()):
    full = [(s, f, "old", "", 0, 0, done, target, status, since, at) for s, f, done, target, status, since, at in rows]
    return spark.createDataFrame(full, P.SCHEMA)


def _replayed(facts, budget, most):
    """summary, ids, count, truncated of each facet, one fact after the other."""
    groups = {}
    for r in facts:
        groups.setdefault((r[0], r[1]), []).append(r)
    found = {}
    for key, rows in groups.items():
        low = lambda v, kind: (v is not None, kind if v is None else v)
        rows = sorted(rows, key=lambda r: (low(r[6], 0), low(r[4], 0.0), low(r[5], 0.0), r[2]), reverse=True)
        taken, used = [], 0
        for r in rows:
            size = min(len(r[3] or ""), 481)
            if len(taken) == most or used >= budget or used + size > budget:
                break
            taken.append(r)
            used += size
        lines = [(r[3] or "").strip() for r in taken[:4]]
        found[key] = ("；".join(x for x in lines if x)[:500], ",".join(str(r[2]) for r in taken[:8]), len(rows), len(rows) - len(taken))
    return found


@pytest.mark.parametrize(("budget", "most"), [(6000, 24), (60, 5), (1, 3)])
def test_build_equals_a_replay(spark, budget, most):
    import random

    rng = random.Random(7)
    facts = [(f"s{rng.randrange(3)}", f"f{rng.randrange(3)}", i, rng.choice([None, "", "  ", "x" * rng.randrange(1, 40), "汉字 " * 3, "y" * 900]), rng.choice([None, 0.5]), rng.choice([None, 0.1, 0.9]), rng.choice([None, _at(rng.randrange(4))])) for i in range(150)]
    asked = spark.createDataFrame([(s, f, 1) for s, f in {(r[0], r[1]) for r in facts}] + [("s0", "gone", 1)], "space string, facet string, expected_revision long")
    found = {(r["space"], r["facet"]): (r["summary"], r["current_ids"], r["fact_count"], r["truncated_count"]) for r in P.build(spark.createDataFrame(facts, FACTS), asked, budget, most).collect()}
    assert found == {**_replayed(facts, budget, most), ("s0", "gone"): ("", "", 0, 0)}


def test_only_asked_facets_are_built(spark):
    facts = spark.createDataFrame([("s", f, i, "text", 0.0, 0.0, _at(i)) for i, f in enumerate("aabb")], FACTS)
    asked = spark.createDataFrame([("s", "b", 3)], "space string, facet string, expected_revision long")
    assert [(r["facet"], r["fact_count"], r["expected_revision"]) for r in P.build(facts, asked).collect()] == [("b", 2, 3)]


def test_changes_raise_targets_and_ask_for_tasks(spark):
    before = _state(spark, [("s", "a", 2, 2, "fresh", None, _at(0)), ("s", "b", 1, 2, "dirty", _at(1), _at(0)), ("s", "c", 5, 5, "fresh", None, _at(0))])
    after = P.mark_dirty(before, spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "new")], "space string, facet string"), _lit(9))
    found = {r["facet"]: (r["processed_revision"], r["target_revision"], r["status"], r["dirty_since"]) for r in after.collect()}
    assert found == {"a": (2, 4, "dirty", _at(9)), "b": (1, 3, "dirty", _at(1)), "c": (5, 5, "fresh", None), "new": (0, 1, "dirty", _at(9))}
    tasks = sorted(r["idempotency_key"] for r in P.rebuild_tasks(before, after).collect())
    assert tasks == [f"semantic-profile:s:{x}" for x in ("a:3", "a:4", "b:3", "new:1")]
    assert [(r["facet"], r["target_revision"]) for r in P.uninitialized(after, 5).collect()] == [("new", 1)]


def test_later_results_win_and_changes_while_building_stay_dirty(spark):
    state = _state(spark, [("s", "won", 1, 2, "dirty", _at(0), _at(0)), ("s", "lost", 4, 5, "dirty", _at(0), _at(0)), ("s", "again", 1, 9, "dirty", _at(0), _at(0)), ("s", "same", 3, 3, "fresh", None, _at(0))])
    built = spark.createDataFrame([("s", f, n, "new", "1", 1, 0) for f, n in [("won", 2), ("lost", 3), ("again", 8), ("absent", 1)]], "space string, facet string, expected_revision long, summary string, current_ids string, fact_count long, truncated_count long")
    found = {r["facet"]: (r["summary"], r["processed_revision"], r["status"], r["dirty_since"], r["updated_at"]) for r in P.save(state, built, _lit(7)).collect()}
    assert found == {"won": ("new", 2, "fresh", None, _at(7)), "lost": ("old", 4, "dirty", _at(0), _at(0)), "again": ("new", 8, "dirty", _at(0), _at(7)), "same": ("old", 3, "fresh", None, _at(0))}


def test_waits_and_ages(spark):
    state = _state(spark, [("s", "early", 0, 1, "dirty", _at(10), _at(10)), ("s", "due", 0, 1, "dirty", _at(9), _at(9)), ("s", "fresh", 1, 1, "fresh", None, _at(10)), ("s", "old", 1, 1, "fresh", None, _at(-3000)), ("s", "older", 2, 2, "fresh", None, _at(-4000))])
    assert [(r["facet"], r["expected_revision"]) for r in P.due(state, _lit(10)).collect()] == [("due", 1)]
    after = {r["facet"]: (r["target_revision"], r["status"]) for r in P.expire(state, _lit(10), 1).collect()}
    assert after["older"] == (3, "dirty") and after["old"] == (1, "fresh") and after["fresh"] == (1, "fresh")
    assert P.due(_state(spark), _lit(0)).count() == P.expire(_state(spark), _lit(0), 3).count() == 0


def test_two_batches_equal_one(spark):
    first = [("s", "abc"[i % 3], i, f"fact {i}", 0.1, 0.2, _at(i)) for i in range(30)]
    second = [("s", "a", 100, "later", 0.1, 0.2, _at(100)), ("t", "d", 101, "other", 0.1, 0.2, _at(101))]
    frame = lambda rows: spark.createDataFrame(rows, FACTS)
    state = P.mark_dirty(_state(spark), frame(first), _lit(0))
    state = P.save(state, P.build(frame(first), P.due(state, _lit(5))), _lit(5))
    state = P.mark_dirty(state, frame(second), _lit(6))
    asked = P.due(state, _lit(9))
    assert {(r["space"], r["facet"]) for r in asked.collect()} == {("s", "a"), ("t", "d")}
    state = P.save(state, P.build(frame(first + second), asked), _lit(9))
    whole = P.mark_dirty(_state(spark), frame(first + second), _lit(0))
    whole = P.save(whole, P.build(frame(first + second), P.due(whole, _lit(5))), _lit(5))
    same = lambda s: sorted(tuple(r) for r in s.drop("updated_at", "dirty_since").collect())
    assert same(state) == same(whole) and {r["status"] for r in state.collect()} == {"fresh"}


def test_lines_show_what_waits(spark):
    facts = spark.createDataFrame([("s", "a", 1, "old", 0.0, 0.0, _at(1)), ("s", "a", 2, "new", 0.0, 0.0, _at(2)), ("s", "b", 3, "alone", 0.0, 0.0, _at(3)), ("s", "c", 4, "unseen", 0.0, 0.0, _at(4))], FACTS)
    state = _state(spark, [("s", "a", 1, 2, "dirty", _at(0), _at(0)), ("s", "b", 1, 1, "fresh", None, _at(0)), ("s", "gone", 1, 1, "fresh", None, _at(0))]).withColumn("summary", F.concat(F.lit("sum "), "facet"))
    sources = spark.createDataFrame([("s", "a", 1)], "space string, facet string, id long")
    found = [r["line"] for r in P.profile_lines(state, sources, facts).orderBy("line_no").collect()]
    assert found == ["sum a", "【最新】new", "sum b", "【最新】unseen"]
