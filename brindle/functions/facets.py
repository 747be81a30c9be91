"""Facets of tasks, facts and events: operations, attributes, topics, progress, closures, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.rules import any_of

# Operations of tasks by the words for them.
OPERATIONS = {
    "学习": "学习", "学": "学习", "学完": "学习", "换": "更换", "换成": "更换", "更换": "更换",
    "更换为": "更换", "替换": "更换", "替换成": "更换", "改成": "修改", "修改": "修改",
    "制作": "制作", "做": "制作", "做完": "制作", "开发": "开发", "实现": "实现", "修复": "修复", "提交": "提交", "上线": "上线",
    "完善": "完善", "部署": "部署", "发布": "发布", "迁移": "迁移", "整理": "整理", "测试": "测试",
    "审查": "审查", "评测": "评测", "执行": "执行", "完成": "执行",
    "处理": "处理", "维护": "维护",
}
NO_OPERATION, ENDED = ("完成", "完成了", "已完成", "做完", "已做完"), ("完成", "做完")
# Reasons for which a task ended, by the names and the words for them.
CLOSURES = {
    "cancelled": "cancelled", "canceled": "cancelled", "取消": "cancelled", "不做了": "cancelled", "不用做": "cancelled",
    "abandoned": "abandoned", "放弃": "abandoned",
    "completed": "completed", "complete": "completed", "done": "completed", "完成": "completed", "做完": "completed", "搞定": "completed",
}
CLOSING = (
    (("取消", "不做了", "不用做", "不再维护"), "cancelled"), (("放弃",), "abandoned"),
    (("已完成", "完成", "做完", "搞定", "弄好", "发布成功", "已提交", "已经提交", "提交", "上线", "学完"), "completed"),
)
# Attributes of facts, by the names and the words for them, and their topics.
ATTRIBUTES = {
    "identity": ("identity", "身份", "个人信息", "交流语言", "preferred_language", "偏好交流语言"), "location": ("location", "居住地", "住址", "所在地", "出生地", "籍贯", "birthplace"),
    "education": ("education", "教育", "学校", "大学", "专业", "school", "major"), "career": ("career", "职业", "工作", "雇主", "公司", "工作单位", "求职目标", "目标岗位", "current_employer", "job_target"),
    "project": ("project", "项目", "当前项目", "current_project"), "learning": ("learning", "学习", "学习重点", "学习方向", "研究", "learning_focus"), "capability": ("capability", "能力", "技能", "技术栈"),
    "device": ("device", "设备", "电脑", "手机", "常用设备", "主要设备", "primary_device"), "other": ("other", "其它", "其他", "fact", "事实"),
}
PLACEHOLDERS = ("fact", "事实", "other", "其它", "其他")
FACTS = (
    (("住在", "居住", "搬到", "住址"), "location"), (("籍贯", "出生地"), "location"), (("学校", "大学", "专业"), "education"), (("求职", "岗位", "目标职位", "工作", "雇主", "跳槽", "公司"), "career"),
    (("项目", "开发", "负责"), "project"), (("学习", "研究", "重点"), "learning"), (("设备", "电脑", "手机"), "device"), (("技能", "能力", "擅长", "会用"), "capability"), (("语言", "身份", "姓名"), "identity"),
)
FACT_TOPICS = {
    "identity": "身份相关事实", "location": "地点相关事实", "education": "教育相关事实", "career": "职业相关事实", "project": "项目相关事实", "learning": "学习相关事实", "capability": "能力相关事实",
    "device": "设备相关事实", "other": "其他长期事实",
}
# Patterns of what holds a task up, of progress, of task attributes and of event times.
BLOCKED = r"(?:被|因|由于|卡在)\s*([^，,。！？!?；;]+?)\s*(?:卡住|阻塞|拦住|挡住)(?:了)?$"
AWAITED, WAITING = ("权限", "数据", "管理员权限"), r"((?:等待|等)\s*[^，,。！？!?；;]+)"
STUCK, STATED = ("阻塞", "卡住", "等待权限", "等待数据", "等确认"), "(?:现在|目前|当前|正在|已经|已)"
PROGRESS = "(继续处理|正在修复失败用例|正在补充测试|正在处理|进行中|暂停)"
NO_ATTRIBUTE = ("task", "任务", "待办", "当前任务", "事项", "fact")
ATTRIBUTE_START = "^(?:正在|继续|已经|需要|计划|准备|待办|记得)"
TASK_START, TASK_END = "^(?:我|本人|用户)(?:需要|准备|计划|正在|继续|记得|请)", "(?:正在|已经|开始|继续|需要|计划|准备|记得|完成|完成了|做完|已做完|了)$"
EVENT_TIME, EVENT_OWNER = "^(?:今天|昨天|前天|刚才|上周|本周|上午|下午|晚上|最近)", "^(?:我|我们|用户)"
# Markers before a piece of evidence that give its polarity.
SAID_POSITIVE, SAID_NEGATIVE = ("喜欢", "更喜欢", "偏好", "偏向", "习惯", "只学", "重点放在"), ("不喜欢", "讨厌", "厌恶", "不爱", "不想", "不打算", "暂时不", "过敏", "不用")


def _clean(text: Column) -> Column:
    """Single blanks between words; null where nothing is left."""
    return F.nullif(T.squeeze(text), F.lit(""))


def _strip(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def _first(rules: list[tuple[Column, str]]) -> Column:
    found = F.lit(None).cast("string")
    for test, value in reversed(rules):
        found = F.when(test, F.lit(value)).otherwise(found)
    return found


def closure_reason(value: Column, source: Column) -> Column:
    """Why a task ended, as a value names it, else as its source says; null if it says nothing."""
    value, source = _clean(value), F.coalesce(source, F.lit(""))
    named = [(F.lower(value).isin(name) | value.isin(name), reason) for name, reason in CLOSURES.items()]
    return F.coalesce(_first([(F.coalesce(t, F.lit(False)), r) for t, r in named]), _first([(any_of(source, words), reason) for words, reason in CLOSING]))


def progress(source: Column) -> Column:
    """A struct of blocker and progress_note: what holds a task up, else how it goes on."""
    text = _strip(F.trim(F.coalesce(source, F.lit(""))), "。！？!?；;")
    marks = " ：:，,。！？!?；;"
    by = F.nullif(_strip(F.regexp_extract(text, BLOCKED, 1), marks), F.lit(""))
    waits = F.nullif(_strip(F.regexp_extract(text, WAITING, 1), marks), F.lit(""))
    waits = F.when(F.startswith(waits, F.lit("等待")), waits).otherwise(F.concat(F.lit("等待"), F.substr(waits, F.lit(2))))
    tail = F.element_at(F.split(text, STATED, 2), -1)
    tail = _strip(F.replace(F.replace(tail, F.lit("卡住"), F.lit("")), F.lit("阻塞"), F.lit("")), marks)
    blocker = (
        F.when(by.isNotNull(), F.when(by.isin(*AWAITED), F.concat(F.lit("等待"), by)).otherwise(by)).when(F.contains(text, F.lit("暂停")), F.lit("暂停")).when(waits.isNotNull(), waits)
        .when(any_of(text, STUCK), F.coalesce(F.nullif(tail, F.lit("")), text))
    )
    return F.struct(blocker.alias("blocker"), F.when(blocker.isNull(), F.nullif(F.regexp_extract(text, PROGRESS, 1), F.lit(""))).alias("progress_note"))


def operation(value: Column, source: Column) -> Column:
    """What a task does: the longest word for an operation in a value, else in its source."""
    value, source = _clean(value), F.coalesce(source, F.lit(""))
    value = F.when(~value.isin(*NO_OPERATION), value)
    ordered = sorted(OPERATIONS.items(), key=lambda x: -len(x[0]))
    named = F.coalesce(_first([(any_of(F.coalesce(value, F.lit("")), (word, name)), name) for word, name in ordered]), value)
    said = F.coalesce(_first([(F.contains(source, F.lit(word)), name) for word, name in ordered if word not in ENDED]), F.when(F.contains(source, F.lit("完成")), "执行"))
    return F.when(value.isNotNull(), named).otherwise(said)


def semantic_attribute(value: Column, source: Column) -> Column:
    """The broad attribute of a fact, as a value names it unless that is a placeholder, else by its source."""
    value = _clean(value)
    given = F.coalesce(value, F.lit(""))
    plain = F.replace(F.lower(given), F.lit(" "), F.lit("_"))
    named = _first([(given.isin(*names) | (plain == name), name) for name, names in ATTRIBUTES.items()])
    return F.coalesce(F.when(~given.isin(*PLACEHOLDERS), named), _first([(any_of(F.coalesce(source, F.lit("")), words), name) for words, name in FACTS]))


def semantic_topic(attribute: Column, fallback: Column) -> Column:
    return F.coalesce(_first([(attribute == name, topic) for name, topic in FACT_TOPICS.items()]), _clean(fallback))


def task_attribute(value: Column, source: Column) -> Column:
    """What a task is about: its value without words of state, else its source without them."""
    marks = " ：:，,。！？!?"
    value = _clean(value)
    own = F.nullif(_strip(F.regexp_replace(F.when(~value.isin(*NO_ATTRIBUTE), value), ATTRIBUTE_START, ""), marks), F.lit(""))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", ""), TASK_START, ""), TASK_END, "")
    return F.coalesce(own, F.nullif(_strip(said, marks), F.lit("")))


def episodic_topic(source: Column, hint: Column) -> Column:
    """What happened: a hint that the source has, else the source without time and owner."""
    source, hint = F.trim(F.coalesce(source, F.lit(""))), _clean(hint)
    plain = F.regexp_replace(F.regexp_replace(source, EVENT_TIME, ""), EVENT_OWNER, "")
    return F.when(F.coalesce(F.contains(source, hint), F.lit(False)), hint).otherwise(_clean(_strip(plain, " ：:，,。！？!?")))


def task_topic(entity: Column, attribute: Column, done: Column, source: Column) -> Column:
    """The topic of a task: operation, entity unless it is the owner, attribute."""
    own = F.coalesce(_clean(entity), F.lit("用户"))
    own = F.when(own.isin("我", "本人", "用户", "user", "me"), F.lit("")).otherwise(own)
    return F.concat(F.coalesce(operation(done, source), F.lit("维护")), own, F.coalesce(task_attribute(attribute, source), F.lit("任务")))


def evidence_atoms(candidates: DataFrame) -> DataFrame:
    """`candidates` with atom_id, the place of their evidence among the note's distinct pieces, and the
    polarity of preferences that lack one by the last marker before it.

    `candidates` has note_id, text, memory_type, evidence_span, polarity and from_model (boolean).
    Pieces are ordered by where they occur, longer ones first; what does not occur has no number.
    """
    span = F.trim(F.coalesce("evidence_span", F.lit("")))
    trimmed = F.regexp_replace(span, r"^(?:和|以及|、|及)\s*", "")
    span = F.when((F.col("memory_type") == "preference") & (trimmed != "") & F.contains("text", trimmed), trimmed).otherwise(span)
    rows = candidates.withColumn("_span", span).withColumn("_at", F.when(F.col("_span") != "", F.nullif(F.position(F.col("_span"), F.col("text")), F.lit(0))))
    pieces = rows.where("_at IS NOT NULL").select("note_id", "_span", "_at").distinct()
    order = Window.partitionBy("note_id").orderBy("_at", F.desc(F.length("_span")), "_span")
    pieces = pieces.select(F.col("note_id").alias("of_note"), F.col("_span").alias("of_span"), F.concat(F.lit("a"), F.row_number().over(order).cast("string")).alias("atom_id"))
    met = rows.join(pieces, (F.col("note_id") == F.col("of_note")) & (F.col("_span") == F.col("of_span")), "left").drop("of_note", "of_span")
    before = F.when(F.col("_at").isNotNull(), F.substring("text", F.lit(1), F.col("_at") - 1)).otherwise(F.lit(""))

    def last(word: str, sign: str) -> Column:
        back = F.instr(F.reverse(before), word[::-1])
        return F.struct(F.when(back == 0, -1).otherwise(F.length(before) - back + 1 - len(word)).alias("at"), F.lit(sign).alias("sign"))

    nearest = F.greatest(*[last(w, "negative") for w in SAID_NEGATIVE], *[last(w, "positive") for w in SAID_POSITIVE])
    open_ = (F.col("memory_type") == "preference") & ~F.col("from_model") & F.coalesce(F.col("polarity"), F.lit("unknown")).isin("unknown") & (F.col("_span") != "") & (nearest["at"] >= 0)
    return met.withColumns({"polarity": F.when(open_, nearest["sign"]).otherwise(F.col("polarity")), "evidence_span": F.col("_span")}).drop("_span", "_at")
