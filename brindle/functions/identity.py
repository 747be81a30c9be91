"""Canonical identities: stable keys of tasks, facts, preferences and events, and families of tasks, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import facets, preference
from brindle.functions import text as T
from brindle.functions.preference import strip

# Operations of tasks by the words for them, in the order in which they are tried.
OPERATIONS = {
    "学习": "学习", "学完": "学习", "学": "学习", "换成": "更换", "更换": "更换", "换": "更换", "替换": "更换", "迁移": "迁移", "制作": "制作", "做完": "制作", "做": "制作", "开发": "开发",
    "实现": "实现", "修复": "修复", "完善": "完善", "修改": "修改", "处理": "处理", "维护": "维护", "执行": "执行", "部署": "部署", "发布": "发布",
}
# Names that are no task's name; words that a family's topic leaves out, and how it begins and ends.
GENERIC = ("task", "任务", "todo", "fact", "事项", "当前任务", "当前学习主题", "待办")
NOISE = (
    "当前学习主题", "当前任务", "已经", "正在", "进行中", "需要", "记得", "待办",
    "完成了", "完成", "已完成", "做完", "已做完", "搞定", "弄好了", "弄好", "取消",
    "不用做", "不做了", "任务", "事项", "制作", "执行", "维护", "学习", "更换", "迁移",
    "开发", "实现", "修复", "完善", "修改", "部署", "发布", "继续", "准备", "计划",
    "的", "也", "了", "一下", "呢", "啊", "呀", "哦", "啦",
)
FAMILY_START = "^(?:继续(?:处理|做)?|正在(?:处理|做)?|开始(?:处理|做)?|处理|维护|执行|完成|做完|修复|完善|测试|评测|部署|发布|开发|实现|迁移|更换|替换|修改|整理|审查)+"
FAMILY_ROUND, FAMILY_DETAIL = r"(?:第[一二三四五六七八九十\d]+(?:轮|阶段|次)|[一二三四五六七八九十\d]+(?:轮|阶段|次))$", "(?:现在|目前|当前)?(?:被|因|由于|卡在|阻塞|等待).*$"
# What follows an operation, what is no material of it, progress, learning, and how a title ends.
MATERIAL, NO_MATERIAL = "(?:了|好|一下)?([^，。！？!?；;、]+)", "^(?:已经|已|正在|进行中|做完|完成|完成了|提交|上线|取消|不做了|不用做|放弃)+$"
MATERIAL_START, PARTICLES = "^(?:了|好|一下|去|将|给|把)+", "(?:呢|啊|呀|了|哦|啦)+$"
IN_PROGRESS = "^(.*?)(?:正在(?:修复失败用例|补充测试|处理)|继续处理)(?:[^，。！？!?；;]*)$"
LEARNT, FILLERS = r"(?:学习|学完|学)\s*([^，。！？!?；;、]{1,40})", "(?:记得|需要|待办|正在|已经|完成|做完|给|把|将|的|了|从|成|为)"
TITLE_ENDS = ("(?:这个|该)?(?:任务|事项)(?:已经|已)?(?:完成|做完|搞定|取消|不做了|不用做|放弃)+$", "(?:这个|该)?(?:任务|事项)$")
MODELS, SUPPLIER, MODEL_SUPPLIER = ("大模型", "模型"), "供应商", "大模型供应商"
# Replacements of one value by another.
REPLACED, REPLACING = r"从\s*([^，。！？!?；;]+?)\s*(?:换成|更换为|改成|替换成)\s*([^，。！？!?；;]+)", r"(?:换|更换|替换)\s*([A-Za-z][A-Za-z0-9._-]*)\s*(?:供应商|模型)?"
# Marks of one instance of a task among others of its family.
ROUNDS, CODES = r"第[一二三四五六七八九十\d]+(?:轮|阶段|次)", r"\b[A-Za-z]+[-_]?\d+(?:\.\d+)?\b"
OWNERS, CURRENT = ("", "我", "本人", "用户", "user", "me"), ("当前", "current", "现在", "目前")
MARKS = " ：:，,。！？!?；;"


def _or(x: Column, y: Column | str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(y) if isinstance(y, str) else y)


def identity(value: Column, fallback: str = "unspecified") -> Column:
    return _or(F.substring(T.normalize_content(value), 1, 120), fallback)


def scope_identity(value: Column) -> Column:
    """A scope normalised; without one it is global."""
    return T.let(identity(value, "global"), lambda s: F.when(s.isin(*CURRENT), "current").otherwise(s))


def owner(value: Column) -> Column:
    value = F.trim(F.coalesce(value, F.lit("")))
    return F.when(value.isin(*OWNERS), F.lit("用户")).otherwise(identity(value))


def _named(value: Column, names: dict[str, str]) -> Column:
    found = value
    for name, to in names.items():
        found = F.when(value == name, F.lit(to)).otherwise(found)
    return found


def action_and_material(text: Column) -> Column:
    """A struct of operation and material: the first operation of a text and what it is done to; null without."""
    words = "|".join(sorted({*OPERATIONS, "完成"}, key=len, reverse=True))
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    found = F.struct(F.regexp_extract(bare, f"({words}){MATERIAL}", 1).alias("word"), F.regexp_extract(bare, f"({words}){MATERIAL}", 2).alias("rest"))

    def cleaned(f: Column) -> Column:
        rest = strip(F.regexp_replace(F.regexp_replace(f["rest"], MATERIAL_START, ""), PARTICLES, ""), " ：:，。！？!?；;、")
        return F.struct(f["word"].alias("word"), rest.alias("rest"))

    def checked(f: Column) -> Column:
        good = (f["word"] != "") & ~f["rest"].rlike(NO_MATERIAL) & (F.length(T.normalize_content(f["rest"])) >= 2)
        name = F.when(f["word"] == "完成", F.lit("执行")).otherwise(_named(f["word"], OPERATIONS))
        return F.when(good, F.struct(name.alias("operation"), F.substring(f["rest"], 1, 80).alias("material")))

    return T.let(found, lambda f: T.let(cleaned(f), checked))


def _first_operation(text: Column) -> Column:
    found = F.lit("维护")
    for word, name in reversed(list(OPERATIONS.items())):
        found = F.when(F.contains(text, F.lit(word)), F.lit(name)).otherwise(found)
    return found


def family_topic(value: Column) -> Column:
    """The goal of a task without its course: no blockers, leading verbs, rounds or words of state."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(T.normalize_content(F.coalesce(value, F.lit(""))), FAMILY_DETAIL, ""), FAMILY_START, ""), FAMILY_ROUND, "")
    for word in sorted(NOISE, key=len, reverse=True):
        if word not in OPERATIONS:
            out = F.replace(out, F.lit(word), F.lit(""))
    return out


def task(text: Column, predicate: Column, task_scope: Column) -> Column:
    """A struct of subject, attribute, operation, topic, family and key of a task, from what a text says of it."""
    text = F.coalesce(text, F.lit(""))

    def read(t: Column) -> Column:
        before = strip(F.regexp_extract(t, IN_PROGRESS, 1))
        learnt = F.regexp_replace(strip(F.regexp_extract(F.regexp_replace(t, r"\s+", ""), LEARNT, 1), "的：: ，。！？!?；;、"), PARTICLES, "")
        return F.struct(t.alias("text"), action_and_material(t).alias("act"), before.alias("before"), F.substring(learnt, 1, 80).alias("learnt"))

    def named(r: Column) -> Column:
        t = r["text"]
        under_way = r["before"] != ""
        bare = F.regexp_replace(t, FILLERS, "")
        for word in OPERATIONS:
            bare = F.replace(bare, F.lit(word), F.lit(""))
        given = F.coalesce(predicate, F.lit(""))
        generic = (given == "") | identity(given).isin(*GENERIC)
        name = (
            F.when(T.mentions(t, MODELS) & F.contains(t, F.lit(SUPPLIER)), F.lit(MODEL_SUPPLIER)).when(under_way, strip(r["before"], " ：:，。！？!?；;")).when(r["act"].isNotNull(), r["act"]["material"])
            .when(r["learnt"] != "", r["learnt"]).when(generic, _or(F.substring(strip(bare, " ，。！？!?；：:;"), 1, 48), "任务")).otherwise(given)
        )
        # The supplier's name comes first, but what is done to it stays what the text says.
        done = F.when(T.mentions(t, MODELS) & F.contains(t, F.lit(SUPPLIER)), _first_operation(t)).when(under_way, F.lit("执行")).otherwise(F.coalesce(r["act"]["operation"], _first_operation(t)))
        return F.struct(t.alias("text"), name.alias("name"), done.alias("done"))

    def trimmed(n: Column) -> Column:
        first = lambda x, pattern: _or(strip(F.regexp_replace(x, pattern, ""), MARKS), x)
        return F.struct(n["text"].alias("text"), T.let(first(n["name"], TITLE_ENDS[0]), lambda x: first(x, TITLE_ENDS[1])).alias("name"), n["done"].alias("done"))

    def stated(n: Column) -> Column:
        name = F.coalesce(facets.task_attribute(n["name"], n["text"]), n["name"])
        return F.struct(name.alias("name"), F.coalesce(facets.operation(n["done"], n["text"]), n["done"]).alias("done"))

    def keyed(s: Column) -> Column:
        family = _or(family_topic(s["name"]), identity(s["name"]))
        key = F.concat_ws(":", F.lit("task"), F.lit("用户"), identity(s["name"]), identity(s["done"]), scope_identity(task_scope))
        return F.struct(F.lit("用户").alias("subject"), s["name"].alias("predicate"), s["done"].alias("operation"), F.concat(s["done"], s["name"]).alias("topic"), F.concat(F.lit("task-family:"), family).alias("family_key"), key.alias("memory_key"))

    return T.let(read(text), lambda r: T.let(named(r), lambda n: T.let(trimmed(n), lambda m: T.let(stated(m), keyed))))


def replaced_values(text: Column) -> Column:
    """A struct of old_value and new_value where a text replaces one by another."""
    text = F.coalesce(text, F.lit(""))
    old, new = F.nullif(strip(F.regexp_extract(text, REPLACED, 1)), F.lit("")), F.regexp_replace(strip(F.regexp_extract(text, REPLACED, 2)), "了+$", "")
    return F.struct(old.alias("old_value"), F.nullif(F.when(old.isNotNull(), new).otherwise(F.regexp_extract(text, REPLACING, 1)), F.lit("")).alias("new_value"))


def preference_identity(signature: Column, text: Column, subject: Column, scope: Column) -> Column:
    """A struct of subject, topic, scope, family and key of a preference."""
    who, topic = owner(subject), _or(signature["topic"], text)
    where = scope_identity(_or(F.when(scope != "global", scope), F.coalesce(F.get(signature["scopes"], F.lit(0)), F.lit("global"))))
    marks = F.filter(F.transform(signature["qualifiers"], lambda q: F.substring(T.normalize_content(q), 1, 120)), lambda q: q != "")
    key = F.concat_ws(":", F.lit("preference"), who, identity(topic), where, marks)
    family = F.concat(F.lit("preference-family:"), who, F.lit(":"), preference.family(topic, text))
    return F.struct(F.lit("用户").alias("subject"), topic.alias("topic"), where.alias("scope"), family.alias("family_key"), key.alias("memory_key"))


def fact_identity(predicate: Column, text: Column, subject: Column) -> Column:
    """A struct of attribute and key of a fact: the same words are the same fact."""
    attribute = F.coalesce(facets.semantic_attribute(predicate, text), F.lit("other"))
    key = lambda a: F.concat_ws(":", F.lit("semantic"), owner(subject), identity(a), F.substring(F.sha2(identity(text).cast("binary"), 256), 1, 16))
    return T.let(attribute, lambda a: F.struct(a.alias("attribute"), key(a).alias("memory_key")))


def event_identity(text: Column, value: Column, subject: Column) -> Column:
    """A struct of topic and key of an event."""
    topic = F.coalesce(facets.episodic_topic(text, value), text)
    return T.let(topic, lambda t: F.struct(t.alias("topic"), F.concat_ws(":", F.lit("episodic"), owner(subject), F.lit("event"), identity(t)).alias("memory_key")))


def instance_marks(*texts: Column) -> Column:
    """The rounds and codes that tell one instance of a task from another, sorted."""
    said = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    codes = F.transform(F.regexp_extract_all(said, F.lit(CODES), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(said, F.lit(ROUNDS), F.lit(0)), codes)))


def family_topics(*values: Column) -> Column:
    """The distinct goals that a task's name, topic and object state; generic ones are none."""
    return F.array_distinct(F.filter(F.transform(F.array(*[F.coalesce(v, F.lit("")) for v in values]), family_topic), lambda t: (t != "") & ~t.isin(*GENERIC)))


def topics_meet(left: Column, right: Column) -> Column:
    """Whether two lists of goals share one, or one of three characters or more lies inside another."""
    inside = lambda a, b: (F.length(a) >= 3) & (F.length(a) <= F.length(b)) & F.contains(b, a)
    return F.arrays_overlap(left, right) | F.exists(left, lambda a: F.exists(right, lambda b: inside(a, b) | inside(b, a)))
