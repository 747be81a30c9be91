"""Candidates from messages, topics of preferences and canonical identities, on statements with known results."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import identity, preference
from brindle.functions import text as T
from brindle.operators.extraction import antecedents, canonical, extract, with_references

MESSAGES = [
    (1, "你好"), (2, "可能以后会学 Java"), (3, "我现在不想继续学习 Java，短期重点放在 Python Agent。"), (4, "记得完善项目 README。"), (5, "我苹果过敏"), (6, "我喜欢咖啡，主要使用MacBook Pro，这周要完成评测。"), (7, "我喜欢咖啡和绿茶。"),
    (8, "数据库迁移已经完成。"), (9, None), (10, ""), (11, "密码是 abcd1234"), (12, "我喜欢咖啡，我喜欢咖啡"), (13, "嗯，总之，昨天参加了发布会，先别急"), (14, "x" * 200_000 + "。我姓王"), (15, "工作日早上喜欢茶和水"), (16, "喜欢早上喝茶和水"), (15, "报告还没写，还在等数据"),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in MESSAGES], "note_id long, text string, memory_type string")
    return canonical(extract(frame)).collect()


def _of(found, note):
    return [r for r in found if r["note_id"] == note]


def test_kinds_of_candidates(found):
    kinds = {n: sorted((r["memory_type"], r["evidence_span"]) for r in _of(found, n)) for n, _ in MESSAGES}
    assert all(kinds[n] == [] for n in (1, 2, 9, 10, 11))
    assert kinds[3] == [("preference", "我现在不想继续学习 Java"), ("preference", "短期重点放在 Python Agent"), ("semantic", "短期重点放在 Python Agent")]
    assert kinds[4] == [("task", "记得完善项目 README")] and _of(found, 4)[0]["task_status"] == "todo"
    assert kinds[5] == [("preference", "我苹果过敏")] and _of(found, 5)[0]["polarity"] == "negative"
    assert {k for k, _ in kinds[6]} == {"preference", "semantic", "task"}
    assert kinds[7] == [("preference", "喜欢咖啡"), ("preference", "绿茶")] and {r["polarity"] for r in _of(found, 7)} == {"positive"}
    assert kinds[8] == [("task", "数据库迁移已经完成")] and _of(found, 8)[0]["closure_reason"] == "completed"
    assert kinds[12] == [("preference", "我喜欢咖啡")]
    assert kinds[13] == [("episodic", "昨天参加了发布会")]
    assert kinds[14] == [("semantic", "姓王")]
    assert [k for k in kinds[15] if k[0] == "preference"] == [("preference", "喜欢茶"), ("preference", "水")]
    assert [k for k in kinds[16] if k[0] == "preference"] == [("preference", "喜欢早上喝茶和水")]
    assert any(r["evidence_span"].startswith("报告还没写，还在等数据") for r in _of(found, 15))


def test_candidates_are_placed_and_weighed(found):
    texts = dict(MESSAGES[:14])
    for r in found:
        if r["clause_start"] is not None and r["note_id"] in (3, 6):
            assert r["evidence_span"] in texts[r["note_id"]][r["clause_start"] : r["clause_end"]] or r["evidence_span"] in texts[r["note_id"]]
        assert (r["importance"], r["confidence"]) == {"preference": (0.75, 0.86), "task": (0.8, 0.82), "semantic": (0.78, 0.84), "episodic": (0.55, 0.72)}[r["memory_type"]]
    assert len({r["candidate_id"] for r in found}) == len(found)


def test_no_messages(spark):
    assert canonical(extract(spark.createDataFrame([], "note_id long, text string"))).count() == 0


@pytest.mark.parametrize(
    ("text", "topic", "qualifiers"),
    [
        ("我喜欢用量子键盘", "量子键盘", []), ("我喜欢听爵士乐", "爵士乐", []), ("我暂时不用机械键盘", "机械键盘", []), ("我对花生过敏", "花生", []), ("我喜欢无糖浓咖啡", "咖啡", ["sugar_free", "strong"]), ("我更喜欢喝茶而不是咖啡了", "茶", []),
        ("我喜欢喝燕麦拿铁，通常选大杯", "燕麦拿铁", ["通常选大杯"]), ("我不喜欢太甜", "sweetness", []), ("工作日喜欢茶", "茶", []), ("浓", "浓", []), ("喜欢浓浓的", "的", ["strong"]), ("", "", []),
    ],
)
def test_topics(spark, text, topic, qualifiers):
    found = spark.range(1).select(preference.signature(F.lit(text)).alias("s")).first()["s"]
    assert (found["topic"], found["qualifiers"]) == (topic, qualifiers)


def test_compatible_topics(spark):
    pairs = [("我喜欢 X1 键盘", "我喜欢 X10 键盘", 0.0), ("我喜欢咖啡", "我讨厌咖啡", 1.0), ("我喜欢 X1", "用 X1", 1.0), ("我喜欢燕麦拿铁", "我喜欢麦拿铁", 0.88), ("我喜欢茶", "我喜欢水", 0.0), ("", "我喜欢茶", 0.0), ("我喜欢 iPhone 15 手机", "喜欢手机 iPhone 15", 0.94)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["c"] for r in frame.select("i", preference.compatibility(preference.signature(F.col("a")), preference.signature(F.col("b"))).alias("c")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(pairs)}
    families = {"甜味饮料": "口味", "绿茶": "饮品", "机械键盘": "设备", "远程办公": "工作方式", "电影": "内容", "苹果": "饮食", "猫": "其他"}
    rows = spark.createDataFrame(list(families.items()), "t string, f string").select("t", "f", preference.family(F.col("t"), F.lit("")).alias("g")).collect()
    assert all(r["f"] == r["g"] for r in rows)
    assert spark.range(1).select(preference.family(F.lit("饮料"), F.lit("太甜的饮料"))).first()[0] == "口味"


def test_alternatives(spark):
    new, old = F.lit("我更喜欢红色键盘"), F.lit("我喜欢黑色键盘")
    ask = lambda a, b: spark.range(1).select(preference.is_alternative(a, preference.signature(a), preference.signature(b))).first()[0]
    assert ask(new, old) and not ask(old, new) and not ask(new, F.lit("我讨厌黑色键盘")) and not ask(new, F.lit("我喜欢茶"))


def test_task_identities(spark):
    texts = ["我需要完成数据库迁移", "正在完成数据库迁移", "记得完善 README", "第一轮测试正在处理", "需要学习 Rust 语言", "发布思维导图版本这个任务已经完成", "把模型供应商从 a 换成 b了", "待办"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", identity.task(F.col("t"), F.lit("task"), F.lit("global")).alias("k"), identity.replaced_values(F.col("t")).alias("v")).collect()
    keys = {r["i"]: r["k"]["memory_key"] for r in rows}
    assert keys[0] == keys[1] == "task:用户:数据库迁移:执行:global"
    assert keys[2] == "task:用户:readme:完善:global" and keys[3] == "task:用户:第一轮测试:执行:global" and keys[4] == "task:用户:rust语言:学习:global"
    assert keys[5].startswith("task:用户:思维导图版本:") and "大模型供应商" in keys[6] and keys[7] == "task:用户:待办:维护:global"
    values = {r["i"]: (r["v"]["old_value"], r["v"]["new_value"]) for r in rows}
    assert values[6] == ("a", "b") and values[0] == (None, None)
    marks = spark.range(1).select(identity.instance_marks(F.lit("第二轮 TASK-12 测试"), F.lit(None).cast("string"))).first()[0]
    assert marks == ["task-12", "第二轮"]
    meet = lambda a, b: spark.range(1).select(identity.topics_meet(identity.family_topics(F.lit(a)), identity.family_topics(F.lit(b)))).first()[0]
    assert meet("数据库迁移", "完成数据库迁移第二轮") and not meet("测试", "接口测试") and not meet("", "")


def test_clause_places(spark):
    text = "第一句话。 第二句话，还在等；ab；第三句"
    spans = spark.createDataFrame([(text,)], "t string").select(T.clause_spans(F.col("t"))).first()[0]
    assert [(s["index"], s["text"]) for s in spans] == [(0, "第一句话"), (1, "第二句话，还在等"), (2, "第三句")]
    assert all(s["text"] in text[s["start"] : s["end"]] for s in spans)
    many = "。".join(f"clause number {i}" for i in range(100))
    assert [s["index"] for s in spark.createDataFrame([(many,)], "t string").select(T.clause_spans(F.col("t"))).first()[0]] == list(range(64))


def test_references(spark):
    rows = [
        ("a1", 1, 1, "user", "需要完成数据库迁移"), ("a2", 1, 2, "assistant", "好的，完成"), ("a3", 1, 3, "user", "这个也做完了"),
        ("b1", 2, 1, "user", "需要完成数据库迁移"), ("b2", 2, 2, "user", "准备修复登录"), ("b3", 2, 3, "user", "这个继续做吧"), ("c1", 3, 1, "user", "这个继续做吧"), ("c2", 3, 2, "user", "它的密码是 abcd1234 完成"), ("c3", 3, 3, None, "那个继续处理"),
        ("d0", 4, 0, "user", "开发接口"), ("d1", 4, 1, "user", "看书"), ("d2", 4, 2, "user", "喝茶"), ("d3", 4, 3, "user", "散步"), ("d4", 4, 4, "user", "这个完成了"),
    ]
    messages = spark.createDataFrame(rows, "note_id string, space int, at int, role string, text string")
    found = {r["note_id"]: r for r in antecedents(messages).collect()}
    assert (found["a3"]["reference_status"], found["a3"]["antecedent_note_id"], found["a3"]["antecedent_offset"]) == ("resolved", "a1", -1)
    assert found["b3"]["reference_status"] == "unresolved" and found["b3"]["only_refers"] and found["c1"]["reference_status"] == "not_applicable"
    assert (found["c3"]["reference_status"], found["c3"]["antecedent_note_id"]) == ("resolved", "c1") and found["d4"]["reference_status"] == "unresolved"
    made = with_references(canonical(extract(messages.select("note_id", "text"))), antecedents(messages)).collect()
    by = {r["note_id"]: r for r in made if r["memory_type"] == "task"}
    assert by["a3"]["memory_key"] == by["a1"]["memory_key"] and by["a3"]["resolution_confidence"] == 0.82 and by["a3"]["task_status"] == "done"
    assert "b3" not in by and {"b1", "b2", "d4"} <= set(by)
