"""Decisions on candidates and what they write, against a replay of them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import adjudication as A
from brindle.operators.extraction import canonical, extract

CANDIDATE = "candidate_id string, note_id long, space long, at long, memory_type string, memory_key string, content string, object_value string, task_status string, polarity string, importance double, confidence double"
MEMORY = "id string, space long, memory_type string, memory_key string, content string, object_value string, task_status string, polarity string, importance double, confidence double, current_version int, status string"


def _merged(old, new):
    return new if old in new else old if new in old else f"{old}；{new}"


def _replay(decisions, candidates, memories, sources, applied):
    """Each decision in the order of its candidate, on the memories as they are by then."""
    known = {m["id"]: dict(m) for m in memories}
    made, cited, versions, relations, done = {}, set(sources), [], [], {}
    from hashlib import sha256

    told = {d["candidate_id"]: d for d in decisions}
    seen = set(applied)
    for c in sorted(candidates, key=lambda c: (c["at"], c["candidate_id"])):
        d = told.get(c["candidate_id"])
        if d is None or c["candidate_id"] in seen:
            continue
        seen.add(c["candidate_id"])
        own = "mem_" + sha256(f"{c['space']}|{c['candidate_id']}".encode()).hexdigest()[:16]
        action, target = d["action"], known.get(d["target_id"])
        if action == "insert" and (c["space"], c["memory_key"]) in made:
            target = known[made[c["space"], c["memory_key"]]]
            stale = True
        else:
            stale = target is not None and d["snapshot_version"] is not None and target["current_version"] != d["snapshot_version"]
        if stale:
            same = c["memory_key"] == target["memory_key"] and (c["task_status"] == target["task_status"] if c["memory_type"] == "task" else bool(c["object_value"]) and c["object_value"] == target["object_value"])
            action = "add_source" if same else "pending_review"

        def cite(memory, relation):
            key = memory, c["note_id"], relation
            new = key not in cited
            cited.add(key)
            return new

        if action in ("insert", "pending_review", "supersede", "conflict"):
            status = {"pending_review": "pending_review", "conflict": "conflicted"}.get(action, "active")
            known[own] = {**{k: c[k] for k in ("memory_key", "content", "object_value", "task_status", "confidence")}, "current_version": 1, "status": status}
            versions.append((own, 1, status))
            cite(own, "created_from")
            if action == "insert":
                made[c["space"], c["memory_key"]] = own
        if action in ("supersede", "conflict"):
            cite(d["target_id"], "contradicted_by")
            target.update(status="superseded" if action == "supersede" else "conflicted", current_version=target["current_version"] + 1)
            versions.append((d["target_id"], target["current_version"], target["status"]))
            names = ("supersedes", "superseded_by") if action == "supersede" else ("conflicts_with", "conflicts_with")
            relations += [(own, d["target_id"], names[0]), (d["target_id"], own, names[1])]
        elif action in ("merge", "update", "update_task"):
            cite(d["target_id"], "supported_by" if action == "merge" else "updated_by")
            target["content"] = _merged(target["content"], c["content"]) if action == "merge" else c["content"]
            target.update(object_value=c["object_value"] or target["object_value"], memory_key=c["memory_key"], current_version=target["current_version"] + 1, confidence=min(0.99, max(target["confidence"], c["confidence"])))
            if action == "update_task":
                target["task_status"] = c["task_status"]
            versions.append((d["target_id"], target["current_version"], target["status"]))
        elif action == "add_source":
            where = made[c["space"], c["memory_key"]] if d["action"] == "insert" else d["target_id"]
            if cite(where, "supported_by") and not (where == d["target_id"] and any(v[0] == where for v in versions)):
                known[where]["confidence"] = min(0.99, max(known[where]["confidence"], known[where]["confidence"] + (c["confidence"] - known[where]["confidence"]) * 0.25 + 0.02))
        done[c["candidate_id"]] = action
    return done, sorted(versions), cited - set(sources), sorted(relations), known


def test_decisions_against_a_replay(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(6)]
    memories = [dict(id=f"m{i}", space=1, memory_type=rng.choice(["task", "preference"]), memory_key=keys[i % 6], content=rng.choice(["ab", "abc", "xyz"]), object_value=rng.choice(["v1", "v2"]), task_status=rng.choice(["todo", "done"]), polarity=None, importance=0.5, confidence=rng.choice([0.3, 0.6]), current_version=rng.choice([1, 4]), status="active") for i in range(5)]
    candidates, decisions = [], []
    for i in range(200):
        m = rng.choice(memories)
        c = dict(candidate_id=f"c{i:03d}", note_id=i % 40, space=1, at=rng.randrange(60), memory_type=m["memory_type"], memory_key=m["memory_key"], content=rng.choice(["ab", "abcd", "new", "xyz"]), object_value=rng.choice(["v1", "v2", None]), task_status=rng.choice(["todo", "done"]), polarity=None, importance=0.6, confidence=rng.choice([0.5, 0.9]))
        action = rng.choice(["insert", "add_source", "add_source", "merge", "update", "update_task", "supersede", "conflict", "pending_review", "discard"])
        insert = action in ("insert", "discard")
        if insert:
            c["memory_key"] = rng.choice(keys) + "n"
        candidates.append(c)
        decisions.append(dict(candidate_id=c["candidate_id"], action=action, relation="r", reason="why", target_id=None if insert else m["id"], snapshot_version=None if insert else m["current_version"] - rng.choice([0, 0, 0, 1]), confidence=0.9))
    sources, applied = [("m0", 3, "supported_by"), ("m1", 5, "updated_by")], ["c005", "c017"]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    told = frame(decisions, "candidate_id string, action string, relation string, reason string, target_id string, snapshot_version int, confidence double")
    given = frame(candidates, CANDIDATE)
    out = A.apply_decisions(told, given.unionByName(given.limit(10)), frame(memories, MEMORY), spark.createDataFrame(sources, "memory_id string, note_id long, relation string"), spark.createDataFrame([(a,) for a in applied], "candidate_id string"))
    done, versions, cited, relations, known = _replay(decisions, candidates, memories, sources, applied)
    assert {r["candidate_id"]: r["action"] for r in out["decisions"].collect()} == done
    assert sorted((r["memory_id"], r["version"], r["status"]) for r in out["versions"].collect()) == versions
    assert {(r["memory_id"], r["note_id"], r["relation"]) for r in out["sources"].collect()} == cited
    assert sorted(tuple(r) for r in out["relations"].collect()) == relations
    for r in out["memories"].collect():
        k = known[r["memory_id"]]
        assert (r["version"], r["status"], r["content"], r["task_status"], r["object_value"]) == (k["current_version"], k["status"], k["content"], k["task_status"], k["object_value"]), r


NOTES = [
    ("m1", "我喜欢咖啡"), ("m2", "需要完成数据库迁移"), ("m3", "我喜欢黑色键盘"), ("m4", "我住在北京"), ("m5", "第一轮测试正在处理"), ("m6", "昨天参加了发布会"), ("m7", "数据库备份已经完成"),
]
SAID = [
    ("c1", "我讨厌咖啡", "update", "preference_polarity_update"), ("c2", "数据库迁移第二轮已经完成", None, None), ("c3", "正在完成数据库迁移", "add_source", None), ("c4", "我更喜欢红色键盘", "pending_review", "ambiguous_preference_conflict"),
    ("c5", "我住在北京", "add_source", "same_semantic_fact"), ("c6", "我住在上海", "insert", None), ("c7", "第二轮测试正在处理", "insert", None), ("c8", "我喜欢茶", "insert", None), ("c9", "已经完成数据库迁移", "update_task", "valid_task_state_transition"),
    ("d1", "需要完成数据库备份", None, None), ("d2", "听说我喜欢咖啡", "pending_review", "unconfirmed_preference_change"),
]


@pytest.fixture(scope="module")
def judged(spark):
    said = canonical(extract(spark.createDataFrame([*NOTES, *[(i, t) for i, t, *_ in SAID]], "note_id string, text string")))
    rows = spark.createDataFrame(said.collect(), said.schema).withColumns({"space": F.lit(1), "at": F.lit(1)})
    memories = rows.where("note_id LIKE 'm%'").withColumns({"id": F.col("note_id"), "status": F.lit("active"), "current_version": F.lit(2), "updated_at": F.to_timestamp(F.lit("2024-01-01"))})
    candidates = rows.where("note_id NOT LIKE 'm%'")
    found = A.adjudicate(candidates, memories)
    return {r["note_id"]: r for r in found.join(candidates.select("candidate_id", "note_id"), "candidate_id").collect()}


def test_decisions_on_statements(judged):
    assert set(judged) == {i for i, *_ in SAID}
    for i, text, action, reason in SAID:
        if action:
            assert judged[i]["action"] == action, (text, judged[i])
        if reason:
            assert judged[i]["reason"] == reason, (text, judged[i])
    assert judged["c9"]["target_id"] == "m2" and judged["c9"]["snapshot_version"] == 2
    assert judged["c4"]["target_id"] == "m3"


def test_nothing_known(spark):
    candidates = spark.createDataFrame([("c1", "c1", "preference", "k", "我喜欢咖啡", 0.8)], "candidate_id string, note_id string, memory_type string, memory_key string, content string, confidence double").withColumns({"space": F.lit(1), "at": F.lit(1)})
    empty = candidates.withColumns({"id": F.col("note_id"), "status": F.lit("active"), "current_version": F.lit(2), "updated_at": F.to_timestamp(F.lit("2024-01-01"))}).limit(0)
    rows = A.adjudicate(candidates, empty).collect()
    assert [(r["action"], r["reason"]) for r in rows] == [("insert", "no_related_active_memory")]
    assert [r["action"] for r in A.adjudicate(candidates.withColumn("should_store", F.lit(False)), empty).collect()] == ["discard"]
