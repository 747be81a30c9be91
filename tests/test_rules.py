"""Text rules, search terms, list tools and lifecycles on small fixtures, most of them in Chinese."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import keys, routes, rules, terms
from brindle.functions import text as T
from brindle.operators import hybrid, lifecycle, lists, metrics
from brindle.streaming import control


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "topic"),
    [("请问我的任务状态是什么", "状态"), ("我喜欢喝咖啡吗？", "喝咖啡"), ("What is my preference about tea", "tea"), (None, ""), ("用户现在的README-01进度", "readme-01")],
)
def test_topic(spark, text, topic):
    assert _value(spark, T.topic_text(F.lit(text).cast("string"))) == topic


@pytest.mark.parametrize(
    ("query", "content", "score"),
    [("咖啡", "咖啡", 1.0), ("我喜欢咖啡", "用户喜欢喝咖啡", 0.9400), ("Agent 项目部署", "Agent 数据清洗", 0.35), ("Python", "Python 3.12 与 Java", 0.9031), ("", "咖啡", 0.0), ("北京天气", "上海天气", 0.1667)],
)
def test_overlap(spark, query, content, score):
    assert _value(spark, T.overlap_score(F.lit(query), F.lit(content))) == pytest.approx(score, abs=1e-3)


def test_terms_of_queries(spark):
    assert _value(spark, terms.memory_terms(F.lit("关于 X-1：咖啡豆"))) == ["x-1", "咖啡豆", "咖啡", "啡豆", "关于", "X-1", "关于x1咖啡豆"]
    assert _value(spark, terms.note_terms(F.lit("请问 PyTorch 咖啡"))) == ["pytorch", "咖啡", "pytorch咖啡"]
    assert _value(spark, T.lexical_terms(F.lit("书 咖啡豆 go1.2"))) == ["go1.2", "书", "咖啡", "啡豆"]
    assert _value(spark, terms.identifiers(F.lit("TASK-12 和 生活-02 x"))) == ["TASK-12", "生活-02"]
    for text, hit in (("see task-12.", True), ("task-123", False), ("xtask-12", False), ("在task-12里", False)):
        assert _value(spark, terms.has_identifier(F.lit(text), F.array(F.lit("TASK-12")))) is hit


@pytest.mark.parametrize(("query", "hit"), [("the cat", True), ("cat the", True), ('"the cat"', True), ('"cat the"', False), ("cat -dog", True), ("cat -the", False), ("dog or cat", True), ("dog", False), ("", False)])
def test_web_match(spark, query, hit):
    assert _value(spark, terms.web_match(terms.lexemes(F.lit("See the cat!")), query)) is hit


@pytest.mark.parametrize(
    ("text", "says", "asks"),
    [("我喜欢咖啡，不喜欢牛奶", "positive", "positive"), ("暂时不吃苹果", "negative", "negative"), ("不喜欢但习惯了", "negative", "negative"), ("我是不是喜欢跑步", "positive", "unknown"), ("偏好是什么", "positive", "unknown"), ("不是这样", "unknown", "unknown"), (None, "unknown", "unknown")],
)
def test_polarity(spark, text, says, asks):
    text = F.lit(text).cast("string")
    assert (_value(spark, rules.polarity(text)), _value(spark, rules.query_polarity(text))) == (says, asks)


@pytest.mark.parametrize(("text", "by_statement"), [("取消会议", "done"), ("下周提交报告", "todo"), ("卡住了", "todo"), ("报告完成了", "done"), ("已经换成新的", "done"), ("你好", None)])
def test_task_states(spark, text, by_statement):
    assert _value(spark, rules.status_from_statement(F.lit(text))) == by_statement
    assert _value(spark, rules.status_from_contract(F.lit("Blocked"), F.lit(text))) == "todo"
    assert _value(spark, rules.legacy_status(F.lit("cancelled"))) == "done"


def test_tags_and_classes(spark):
    tags = F.array(*[F.lit(x) for x in ("#运动", "运动", "生活", "外星", "重要")])
    assert _value(spark, rules.normalize_tags(tags, F.lit("生活"))) == ["运动", "重要"]
    assert _value(spark, rules.normalize_tags(F.lit(None).cast("array<string>"), F.lit("学习"))) == ["概念", "方法"]
    found = _value(spark, rules.classify(F.lit("  今天 很开心。去 跑步 ")))
    assert (found["type"], found["tags"], found["title"]) == ("情绪", ["开心", "焦虑"], "今天 很开心")
    assert _value(spark, rules.identifiers_compatible(F.lit("修 API-2"), F.lit("改 api-2"))) is True
    assert _value(spark, rules.identifiers_compatible(F.lit("修 API-2"), F.lit("修 API-3"))) is False


def test_gate(spark):
    for text, may in (("我姓王", True), ("好的", False), ("ok", False), (None, False), ("我的手机是小米", True), ("x" * 24, True), ("token=abcdef1234 我喜欢", False)):
        assert _value(spark, rules.may_hold_memory(F.lit(text).cast("string"))) is may


def test_policy_score_vetoes_the_other_polarity(spark):
    schema = "id int, memory_type string, content string, memory_key string, subject string, predicate string, object_value string, status string, task_status string, importance double, confidence double, access_count int, polarity string, updated_at timestamp"
    import datetime as dt

    at = dt.datetime(2024, 5, 30)
    rows = [(1, "preference", "用户不喜欢咖啡", "k", None, None, None, "active", None, 0.5, 0.8, 3, None, at), (2, "preference", "用户喜欢咖啡", "k", None, None, None, "active", None, 0.5, 0.8, 3, None, at), (3, "semantic", "咖啡", "k", None, None, None, "forgotten", None, 0.5, 0.8, 3, None, at)]
    scored = spark.createDataFrame(rows, schema).select("id", hybrid.memory_score(F.lit("我喜欢咖啡"), F.to_timestamp(F.lit("2024-06-01"))).alias("s")).collect()
    found = {r["id"]: r["s"] for r in scored}
    assert found[1] == 0.0 and found[2] == pytest.approx(0.72 + 0.08 + 0.035 + 0.05 + 0.04 + 0.009, abs=1e-4)
    assert found[3] == pytest.approx((0.72 + 0.035 + 0.05 + 0.04 + 0.009) * 0.2, abs=1e-4)


def test_cover_spreads_listing_questions(spark):
    rows = [(1, q, i, s, t, f, False) for q in ("列出记忆",) for i, s, t, f in ((1, 0.90, "semantic", "a"), (2, 0.89, "semantic", "a"), (3, 0.80, "task", "b"), (4, 0.85, "semantic", "c"))]
    schema = "query_id int, query string, id int, score double, memory_type string, identity string, stated boolean"
    found = lists.cover(spark.createDataFrame(rows, schema), 3).orderBy("rank").collect()
    assert [r["id"] for r in found] == [1, 4, 3]
    plain = lists.cover(spark.createDataFrame([(1, "咖啡", *r[2:]) for r in rows], schema), 3).orderBy("rank").collect()
    assert [r["id"] for r in plain] == [1, 2, 4]


def test_profile_and_histories(spark):
    rows = spark.createDataFrame([(1, "task", "active", "t", 5), (2, "task", "active", "t", 9), (3, "task", "forgotten", "u", 7), (4, "semantic", "active", None, 1)], "id int, memory_type string, status string, canonical_topic string, updated_at int")
    assert {(r["id"], r["place"]) for r in lists.current_profile(rows, {"task": 3, "semantic": 1}).collect()} == {(2, 1), (4, 1)}
    versions = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, version int")
    old = spark.createDataFrame([(1, "forgotten", 0.1), (2, "active", 0.9)], "id int, status string, overlap double")
    assert {(r["id"], r["version"], r["score"]) for r in lists.stale_history(old, versions).collect()} == {(1, 1, 0.45), (1, 2, 0.45)}


def test_contents_merge(spark):
    for old, new, want in (("喝咖啡", "早上喝咖啡", "早上喝咖啡"), ("早上喝咖啡。", "喝咖啡", "早上喝咖啡。"), ("喝茶。", "用户跑步；", "喝茶；跑步"), ("", "x", "x")):
        assert _value(spark, lifecycle.merged_content(F.lit(old), F.lit(new))) == want
    assert _value(spark, lifecycle.confirmed_confidence(F.lit(0.5), F.lit(0.9))) == pytest.approx(0.62)
    assert _value(spark, lifecycle.combined_confidence(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.7)
    assert [_value(spark, lifecycle.is_due(c, F.to_date(F.lit("2024-04-01")))) for c in ("daily", "weekly", "monthly")] == [True, True, True]


def test_relations_of_a_memory(spark):
    rows = spark.createDataFrame([(1, 7, 8, 2), (2, 9, 7, 1), (3, 8, 9, 0)], "id int, source_id int, target_id int, created_at int")
    assert [r["id"] for r in lifecycle.relations_of(rows, F.lit(7)).collect()] == [2, 1]


def test_slots_against_replay(spark):
    import random

    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", i, rng.randrange(200)) for i in range(120)]
    claims = spark.createDataFrame(rows, "k string, c long, s long").select("k", "c", F.timestamp_seconds("s").alias("ts"))
    found = {r["c"]: (r["held"], r["admitted"]) for r in control.slots(claims, ["k"], "ts", "c", 30, 2).collect()}
    live: dict = {}
    for k, c, s in sorted(rows, key=lambda r: (r[2], r[1])):
        live[k] = [x for x in live.get(k, []) if x + 30 > s]
        assert found[c] == (len(live[k]), len(live[k]) < 2)
        if len(live[k]) < 2:
            live[k].append(s)


def test_percentiles_of_no_rows(spark):
    rows = spark.createDataFrame([(None, 5.0)], "a double, b double")
    found = metrics.percentile_columns(rows, ["a", "b"], {"p50": 0.5}).first()
    assert found["p50_a"] is None and found["p50_b"] == 5.0


@pytest.mark.parametrize(
    ("question", "complexity", "strategies", "reasons"),
    [
        ("", "simple", ["none"], ["empty_query"]),
        ("比较 A 和 B", "complex", ["decomposition"], ["comparison_or_difference"]),
        ("不要比较，直接说结论", "simple", ["none"], ["negated_complex_operations"]),
        ("为什么它失败了", "complex", ["step_back", "rewrite"], ["causal_or_temporal_analysis", "unresolved_reference"]),
        ("只查询咖啡", "simple", ["none"], ["explicit_single_scope"]),
        ("那个呢", "uncertain", ["rewrite"], ["unresolved_reference"]),
        ("其它城市", "simple", ["none"], ["single_clause_single_intent"]),
        ("项目怎么样", "uncertain", ["rewrite"], ["ambiguous_status_wording"]),
        ("先查任务；再看笔记", "complex", ["decomposition"], ["multiple_question_clauses"]),
        ("长" * 51, "uncertain", ["rewrite"], ["long_or_mixed_query"]),
    ],
)
def test_routes(spark, question, complexity, strategies, reasons):
    found = _value(spark, routes.route(F.lit(question)))
    assert (found["complexity"], found["strategies"], found["reasons"]) == (complexity, strategies, reasons)


def test_ids_and_keys(spark):
    import uuid

    want = "cand_" + uuid.uuid5(uuid.NAMESPACE_URL, "n1\x1ftask\x1f写报告").hex[:16]
    assert _value(spark, keys.candidate_id(F.lit("n1"), F.lit("task"), F.lit("我 写报告！"))) == want
    want = "cand_" + uuid.uuid5(uuid.NAMESPACE_URL, "n1\x1f2\x1ftask\x1f\x1f写报告").hex[:16]
    assert _value(spark, keys.evidence_id(F.lit("n1"), F.lit(2), F.lit("task"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("写报告"))) == want
    none = F.lit(None).cast("string")
    key = lambda kind, subject, predicate, value, content: _value(spark, keys.memory_key(F.lit(kind), subject, predicate, value, F.lit(content)))
    assert key("preference", none, none, none, "我不喜欢喝咖啡") == key("preference", F.lit("用户"), none, none, "我喜欢喝咖啡") == "preference:用户:咖啡:global"
    assert key("task", F.lit("me"), none, F.lit("完成报告了"), "x") == "task:user:task:报告"
    assert key("semantic", none, F.lit("city"), none, "") .startswith("semantic:用户:city:")
    assert _value(spark, keys.space_id(F.lit("p2p"), F.lit("c"), F.lit("u"))) == "p_u" and _value(spark, keys.space_id(F.lit("group"), F.lit("c"), F.lit("u"))) == "g_c"
    assert _value(spark, keys.message_text(F.lit('{"text": "a b"}'))) == "a b" and _value(spark, keys.message_text(F.lit("not json"))) == ""
    assert _value(spark, keys.without_mentions(F.lit("@_1 <at id=2>x</at> hello @_1"), F.array(F.lit("@_1")))) == "hello"
    assert _value(spark, keys.split_tags(F.lit("a， b、,c"))) == ["a", "b", "c"]


def test_episodes_merge_in_order(spark):
    import datetime as dt

    from brindle.operators import matching

    schema = "space string, id int, memory_type string, content string, memory_key string, subject string, predicate string, object_value string, status string, task_status string, importance double, confidence double, access_count int, polarity string, updated_at timestamp"
    texts = {1: "昨天参加了发布会", 2: "昨天参加了发布会", 3: "昨天参加了发布会", 4: "去上海出差"}
    rows = [("s", i, "episodic", t, None, None, None, None, "active", None, 0.5, 0.8, 0, None, dt.datetime(2024, 1, i)) for i, t in texts.items()]
    found = matching.episode_merges(spark.createDataFrame(rows, schema), F.to_timestamp(F.lit("2024-01-05"))).collect()
    assert {(r["keeper_id"], r["merged_id"]) for r in found} == {(3, 2), (3, 1)}


def test_tasks_match_by_kind(spark):
    from brindle.operators import matching

    columns = "memory_key string, subject string, predicate string, object_value string, content string, canonical_topic string, operation string, scope string"
    candidate = [("s", 1, "k1", "我", "季度报告", None, "写季度报告", None, "修改", None)]
    rows = [
        ("s", i, "active", "task", i, *r)
        for i, r in enumerate([
            ("k1", "他", "x", None, "y", None, None, "global"), ("k2", "我", "季度报告", None, "y", None, "修改", None), ("k3", "我", "报告", None, "y", None, "执行", None), ("k4", "我", "报告季度版", None, "y", None, None, None), ("k5", "我", "报告", None, "y", None, None, "team"),
        ])
    ]
    found = matching.task_matches(spark.createDataFrame(candidate, "space string, candidate_id int, " + columns), spark.createDataFrame(rows, "space string, id int, status string, memory_type string, updated_at int, " + columns))
    # The owner's words are no part of a key, so all subjects but one are equal.
    assert [(r["id"], r["kind"]) for r in found.orderBy("rank").collect()] == [(0, "exact_key"), (1, "structured_identity"), (2, "identity_compatible")]


def test_facets(spark):
    from brindle.functions import facets

    none = F.lit(None).cast("string")
    for text, blocker, note in (("接口被权限卡住", "等待权限", None), ("开发因文档不完整阻塞了", "文档不完整", None), ("暂停", "暂停", None), ("等老板回复", "等待老板回复", None), ("报告现在阻塞", "报告现在", None), ("继续处理报告", None, "继续处理"), ("写报告", None, None)):
        found = _value(spark, facets.progress(F.lit(text)))
        assert (found["progress_note"], text != "报告现在阻塞" and found["blocker"] or None) == (note, blocker if text != "报告现在阻塞" else None)
    assert [_value(spark, facets.closure_reason(none if v is None else F.lit(v), F.lit(s))) for v, s in (("Done", ""), (None, "放弃了"), (None, "报告已提交"), (None, "写报告"), ("x", "取消"))] == ["completed", "abandoned", "completed", None, "cancelled"]
    assert [_value(spark, facets.operation(none if v is None else F.lit(v), F.lit(s))) for v, s in (("替换成新版", ""), ("已完成", "修复登录"), (None, "完成"), (None, "看书"), ("散步", ""))] == ["更换", "修复", "执行", None, "散步"]
    assert [_value(spark, facets.semantic_attribute(none if v is None else F.lit(v), F.lit(s))) for v, s in (("工作单位", ""), ("事实", "我住在北京"), (None, "擅长画画"), ("Learning", ""), ("其他", "你好"))] == ["career", "location", "capability", "learning", None]
    assert _value(spark, facets.semantic_topic(F.lit("device"), none)) == "设备相关事实"
    assert _value(spark, facets.task_topic(F.lit("我"), F.lit("正在写报告"), none, F.lit("提交报告"))) == "提交写报告"
    assert _value(spark, facets.episodic_topic(F.lit("昨天我参加了会议。"), none)) == "参加了会议"


def test_evidence_atoms(spark):
    from brindle.functions import facets

    text = "我喜欢咖啡和茶，不喜欢牛奶"
    rows = [(1, 1, text, "preference", "和茶", None, False), (2, 1, text, "preference", "咖啡", "unknown", False), (3, 1, text, "preference", "牛奶", None, False), (4, 1, text, "task", "没有", None, False), (5, 1, text, "preference", "牛奶", None, True)]
    found = facets.evidence_atoms(spark.createDataFrame(rows, "id int, note_id int, text string, memory_type string, evidence_span string, polarity string, from_model boolean"))
    # The last marker counts, even one inside a longer one.
    assert {r["id"]: (r["atom_id"], r["polarity"]) for r in found.collect()} == {1: ("a2", "positive"), 2: ("a1", "positive"), 3: ("a3", "positive"), 4: (None, None), 5: ("a3", None)}
