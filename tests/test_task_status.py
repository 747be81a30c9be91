"""Questions about tasks: what they name, tasks before events, families, bounds."""

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import task_status as S

MEMORY = "id long, memory_type string, content string, memory_key string, subject string, predicate string, object_value string, status string, task_status string, importance double, confidence double, access_count long, polarity string, updated_at timestamp, scope string"


def _memory(i, kind, content, scope=None, status="active"):
    return (i, kind, content, f"k{i}", "s", "p", None, status, "todo", 0.9, 0.9, 5, None, dt.datetime(2024, 5, 31) + dt.timedelta(minutes=i), scope)


def _search(spark, questions, rows, limit=8):
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")
    found = S.task_status_search(asked, spark.createDataFrame(rows, MEMORY), F.to_timestamp(F.lit("2024-06-01 00:00:00")), limit).collect()
    return sorted((r["query_id"], r["rank"], r["id"], r["role"]) for r in found)


def test_anchor(spark):
    questions = ["license 任务进展如何", "任务怎么样了", "我的 notice 任务 notice 状态", "a b", "季度报告的进展 季度报告", "", None]
    frame = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    assert [r["a"] for r in frame.select("i", S.anchor(F.col("q")).alias("a")).orderBy("i").collect()] == ["license", "", "notice", "", "季度报告", "", ""]


def test_named_tasks_then_events_of_their_families(spark):
    rows = [
        _memory(1, "task", "完成季度报告", '{"task_family_key": "fam-1"}'), _memory(2, "task", "修复登录问题", '{"task_family_key": "fam-2"}'),
        _memory(3, "episodic", "昨天和同事讨论季度报告"), _memory(4, "episodic", "季度数据已经交给同事", '{"related_task_family_key": "fam-1"}'),
        _memory(5, "episodic", "季度聚餐", '{"related_task_family_key": "fam-2"}'), _memory(6, "semantic", "季度报告在共享盘"), _memory(7, "task", "提交季度报告", "no json"),
    ]
    found = _search(spark, ["季度报告的进展"], rows)
    assert {(i, role) for _, _, i, role in found} == {(1, "current_task"), (7, "current_task"), (3, "historical_event"), (4, "historical_event")}
    assert [role for *_, role in found] == ["current_task"] * 2 + ["historical_event"] * 2 and [r for _, r, *_ in found] == [1, 2, 3, 4]


def test_bounds_and_nothing(spark):
    rows = [_memory(i, "task" if i < 30 else "episodic", f"alpha report {i}") for i in range(36)]
    found = _search(spark, ["alpha report", None], rows, limit=5)
    assert [(q, n, role) for q, n, _, role in found] == [(0, n, "current_task") for n in range(1, 6)]
    events = _search(spark, ["alpha report"], rows[29:], limit=5)
    assert [role for *_, role in events] == ["current_task", "historical_event", "historical_event"]
    assert _search(spark, ["alpha report"], [], 5) == []
