"""Rules on messages, notes and candidates: classes, tags, gates, polarity, task states, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.sensitive import is_sensitive

# Note types, the tags of every type and the tags of each.
NOTE_TYPES = ("任务", "学习", "灵感", "资料", "生活", "情绪")
GLOBAL_TAGS = ("重要", "待处理", "计划", "复盘", "问题", "决定", "提醒", "想法", "总结", "长期", "短期", "待确认")
TYPE_TAGS = {
    "任务": ("待办", "进行中", "已完成", "优先级", "截止时间", "阻塞", "跟进", "安排", "协作", "检查"),
    "学习": ("概念", "方法", "笔记", "课程", "书籍", "论文", "练习", "疑问", "总结", "知识点"),
    "灵感": ("创意", "观察", "设计", "写作", "产品想法", "改进", "灵光一闪", "素材", "可能性"),
    "资料": ("链接", "文档", "收藏", "引用", "清单", "工具", "教程", "数据", "案例", "备查"),
    "生活": ("饮食", "运动", "睡眠", "健康", "出行", "消费", "家务", "社交", "娱乐", "日常"),
    "情绪": ("开心", "焦虑", "压力", "疲惫", "低落", "期待", "烦躁", "平静", "感激", "困惑"),
}
# Markers of the rule classifier, in the order in which the rules are tried.
TASK_WORDS = ("记得", "待办", "todo", "需要", "提醒", "计划", "跟进", "截止", "完成", "修复", "实现")
MOOD_WORDS = ("焦虑", "压力", "疲惫", "低落", "开心", "烦躁", "平静", "感激", "情绪")
STUDY_WORDS = ("学习", "课程", "书", "论文", "练习", "知识", "研究", "教程")
IDEA_WORDS = ("灵感", "创意", "想法", "设计", "可以做", "改进")
SOURCE_WORDS = ("链接", "文档", "收藏", "备查", "资料")
FOOD_WORDS = ("吃", "喝", "咖啡", "茶", "水果", "餐")
SPORT_WORDS = ("跑步", "健身", "运动", "游泳", "骑行")
UNTITLED, UNSUMMED = "随手记录", "一条随手记录。"
# Texts without value, markers of memories, and patterns of short facts.
LOW_VALUE_PATTERNS = ("你好", "hello", "hi", "收到", "好的", "ok", "哈哈", "嗯", "嗯嗯", "今天天气不错")
LOW_VALUE_TEXTS = ("你好", "您好", "hello", "hi", "收到", "好的", "好", "ok", "谢谢", "哈哈", "嗯", "嗯嗯")
MEMORY_MARKERS = (
    "喜欢", "不喜欢", "更喜欢", "讨厌", "暂时不", "不喝", "不吃", "不用", "偏好", "习惯", "过敏", "记得", "需要", "待办", "todo", "跟进",
    "完成", "做完", "已做完", "学完", "已学完", "弄好", "提醒", "计划", "报名", "正在", "重点", "学习", "研究", "开发", "负责", "更换",
    "换成", "改成", "住在", "搬到", "今天", "昨天", "刚才", "参加", "发布",
)
SHORT_FACT_PATTERNS = (
    r"^(?:我|本人|用户)是[^。！？!?；;，,]{1,40}$",
    r"^(?:我|本人|用户)姓[^。！？!?；;，,]{1,12}$",
    r"^(?:我|本人|用户)(?:来自|有|养了|会|不会)[^。！？!?；;，,]{1,40}$",
    r"^(?:我|本人|用户)在[^。！？!?；;，,]{1,40}工作$",
    r"^(?:我|本人|用户)的[^。！？!?；;，,]{1,30}是[^。！？!?；;，,]{1,40}$",
    r"^[^。！？!?；;，,]{1,30}是(?:我|本人|用户)的[^。！？!?；;，,]{1,20}$",
)
LONG_ENOUGH, MIN_CONFIDENCE = 24, 0.45
# Markers of polarity, and the verbs that a plain "not" may stand before.
NEGATIVE_MARKERS = (
    "不再喜欢", "不再", "不喜欢", "不想要", "不想", "不打算", "不愿意", "不愿", "不要", "不爱", "讨厌", "厌恶", "避免", "避开", "拒绝", "过敏",
)
POSITIVE_MARKERS = ("更喜欢", "最喜欢", "喜欢", "偏好", "习惯", "想要", "倾向于", "偏向", "更偏向", "优先选择", "优先")
NEGATED_ACTION = r"(?:暂时|目前|现在)?不(?:再)?(?:吃|喝|用|使用|采用|选择|选|穿|看|听|玩|住|做|学习|学|买|去)"
ASKING_START = ("是否", "是不是", "do i ", "did i ", "what ", "which ")
ASKING_OWNER, ASKING_END = r"(?:我|用户)?(?:是否|是不是|有没有)", r"(?:哪种|哪个|什么偏好|偏好是什么|习惯是什么|吗|嘛|呢)$"
HABIT_WORDS, HABIT_QUESTIONS = ("偏好", "习惯"), ("对应", "是什么", "怎么", "如何", "记录", "查", "找", "最近", "关于")
# Identifiers of tasks, and the rules of task states in order: markers, further markers, state.
TASK_TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9+#._-]*|\d+(?:[._-]\d+)*"
STATEMENT_STATES = (
    (("取消", "不用做", "不做了", "放弃"), None, "done"),
    (("这周", "本周", "下周", "明天", "之后", "计划", "准备"), ("完成", "提交", "上线", "发布"), "todo"),
    (("卡住", "阻塞", "等确认", "等待", "暂停"), None, "todo"),
    (("正在", "进行中", "继续"), None, "todo"),
    (("需要", "记得", "待办", "要做", "准备", "计划"), None, "todo"),
    (("完成", "搞定", "已做完", "做完", "学完", "已学完", "弄好", "弄好了", "提交", "上线"), None, "done"),
    (("已经",), ("换成", "更换为", "改成", "替换成", "部署", "发布"), "done"),
    (("准备",), ("最近", "现在", "重点"), "todo"),
)
CONTRACT_STATES = (
    (("取消", "不做了", "不用做", "不再维护", "放弃"), None, "done"),
    (("阻塞", "卡住", "等待权限", "等待数据", "等确认"), None, "todo"),
    (("已完成", "完成", "做完", "搞定", "弄好", "发布成功", "已提交", "提交", "上线", "学完"), None, "done"),
    (("正在", "进行中", "继续", "需要", "计划", "准备", "待办", "要做"), None, "todo"),
)
STATE_ALIASES = {
    "todo": ("todo", "pending", "in_progress", "in progress", "进行中", "正在", "继续", "blocked", "阻塞", "卡住", "等待权限", "等待数据"),
    "done": ("done", "completed", "complete", "完成", "已完成", "做完", "搞定", "cancelled", "canceled", "取消", "不做了", "不用做", "abandoned", "放弃"),
}
LEGACY_STATES = {"in_progress": "todo", "blocked": "todo", "cancelled": "done", "canceled": "done"}
# Markers of questions about memories and about notes.
MEMORY_QUESTIONS = (
    "喜欢", "讨厌", "偏好", "习惯", "过敏", "当前待办", "现在的任务", "待办是什么", "任务进度", "做到哪了", "有进展吗", "完成了吗", "换得怎么样",
    "弄好了吗", "住在哪里", "住哪", "现在住", "正在学习", "当前项目", "what do i like", "preference", "todo", "current task", "where do i live",
)
NOTE_QUESTIONS = ("最近", "笔记", "记录", "记了", "写了", "/type", "/tag", "标签", "类型", "recent", "record", "note")
# Markers of the memory type that a question expects.
ASKS_PREFERENCE = ("喜欢", "不喜欢", "偏好", "讨厌", "避开", "过敏")
ASKS_STATUS, NOT_STATUS = ("任务状态", "是什么状态", "状态如何", "状态怎么样", "当前状态", "目前状态", "task status"), ("状态记忆", "状态层", "状态或结论")
ASKS_TASK = ("待办", "任务", "要做", "需要处理", "进度", "完成", "取消", "task status")
ASKS_SEMANTIC = ("结论", "事实", "关注", "背景", "住哪", "住在")
OPEN_TASK_WORDS, CLOSED_TASK_WORDS = ("待办", "要做", "未完成", "还要"), ("状态", "完成", "取消", "做完")


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text contains one of the markers."""
    return reduce(lambda c, m: c | F.contains(text, F.lit(m)), markers[1:], F.contains(text, F.lit(markers[0])))


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_type(value: Column) -> Column:
    """A listed note type, else the type of sources."""
    value = F.trim(F.coalesce(value, F.lit("")))
    return F.when(value.isin(*NOTE_TYPES), value).otherwise(F.lit("资料"))


def allowed_tags(note_type: Column) -> Column:
    """The tags of a type, then those of every type."""
    found = _strings(GLOBAL_TAGS)
    for name, tags in TYPE_TAGS.items():
        found = F.when(note_type == name, _strings(tags + GLOBAL_TAGS)).otherwise(found)
    return found


def normalize_tags(tags: Column, note_type: Column) -> Column:
    """The allowed tags among `tags`, five at most; where there are fewer than two, the first allowed ones follow."""
    allowed = F.filter(F.array_distinct(allowed_tags(note_type)), lambda t: t != note_type)
    plain = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.trim(F.coalesce(t, F.lit(""))), "^#+", ""))
    kept = F.slice(F.filter(F.array_distinct(plain), lambda t: F.array_contains(allowed, t)), 1, 5)
    return F.when(F.size(kept) >= 2, kept).otherwise(F.concat(kept, F.slice(F.array_except(allowed, kept), F.lit(1), 2 - F.size(kept))))


def classify(text: Column) -> Column:
    """Type, tags, title and summary of a note by rules."""
    value = T.squeeze(text)
    low = T.casefold(value)
    mood = F.lit("困惑")
    for tag in reversed(TYPE_TAGS["情绪"]):
        mood = F.when(F.contains(value, F.lit(tag)), F.lit(tag)).otherwise(mood)
    source = any_of(low, ("http://", "https://")) | any_of(value, SOURCE_WORDS)
    rules = [(any_of(low, TASK_WORDS), "任务"), (any_of(value, MOOD_WORDS), "情绪"), (any_of(low, STUDY_WORDS), "学习"), (any_of(value, IDEA_WORDS), "灵感"), (source, "资料")]
    note_type = F.lit("生活")
    for test, name in reversed(rules):
        note_type = F.when(test, F.lit(name)).otherwise(note_type)
    tags = (
        F.when(note_type == "任务", _strings(("待办", "提醒"))).when(note_type == "情绪", F.array(mood, F.lit("日常"))).when(note_type == "学习", _strings(("笔记", "知识点")))
        .when(note_type == "灵感", _strings(("创意", "想法"))).when(note_type == "资料", _strings(("备查", "收藏"))).when(any_of(value, FOOD_WORDS), _strings(("饮食", "日常")))
        .when(any_of(value, SPORT_WORDS), _strings(("运动", "日常"))).otherwise(_strings(("日常", "长期")))
    )
    first = F.regexp_replace(F.get(F.split(value, "[。！？]"), F.lit(0)), "^[ ，,；;]+|[ ，,；;]+$", "")
    or_else = lambda x, y: F.when(x == "", F.lit(y)).otherwise(x)
    return F.struct(note_type.alias("type"), normalize_tags(tags, note_type).alias("tags"), or_else(F.substring(first, 1, 20), UNTITLED).alias("title"), or_else(F.substring(value, 1, 120), UNSUMMED).alias("summary"))


def may_hold_memory(text: Column, more: Column | None = None) -> Column:
    """Whether a message may hold a memory: not empty, worthless or sensitive, and with a marker (in
    itself or in `more`, its title, summary and tags), a short fact, or some length."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    compact = T.casefold(F.regexp_replace(raw, r"\s+", ""))
    skipped = compact.isin(*LOW_VALUE_PATTERNS) | (F.length(compact) <= 2) | is_sensitive(raw)
    searched = raw if more is None else F.concat_ws(" ", raw, more)
    return ~skipped & (any_of(searched, MEMORY_MARKERS) | raw.rlike("|".join(SHORT_FACT_PATTERNS)) | (F.length(raw) >= LONG_ENOUGH))


def _first_place(text: Column, markers: tuple[str, ...]) -> Column:
    return F.least(*[F.nullif(F.instr(text, m), F.lit(0)) for m in markers])


def polarity(text: Column) -> Column:
    """positive, negative or unknown: the earliest marker counts, negative on a tie."""
    text = F.coalesce(text, F.lit(""))
    negative = F.least(_first_place(text, NEGATIVE_MARKERS), F.nullif(F.regexp_instr(text, F.lit(NEGATED_ACTION)), F.lit(0)))
    positive = _first_place(text, POSITIVE_MARKERS)
    return F.when(negative.isNotNull() & (positive.isNull() | (negative <= positive)), "negative").when(positive.isNotNull(), "positive").otherwise("unknown")


def query_polarity(text: Column) -> Column:
    """The polarity that a question asks for; unknown where it asks what the preference is."""
    value = T.squeeze(text)
    asking = any_of(value, ("?", "？")) | (any_of(value, HABIT_WORDS) & any_of(value, HABIT_QUESTIONS)) | value.rlike(ASKING_OWNER) | F.regexp_replace(value, "[。！!]+$", "").rlike(ASKING_END)
    asking = reduce(lambda c, w: c | F.startswith(T.casefold(value), F.lit(w)), ASKING_START, asking)
    return F.when(asking, F.lit("unknown")).otherwise(polarity(value))


def task_identifiers(text: Column) -> Column:
    """The distinct tokens of a task that identify it: with a digit, a mark of code, or in capitals."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TASK_TOKEN_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda t: t.rlike(r"[0-9#._-]") | (t == F.upper(t))), F.lower)))


def identifiers_compatible(left: Column, right: Column) -> Column:
    """Whether two tasks name the same identifiers, or one of them none."""
    a, b = task_identifiers(left), task_identifiers(right)
    return (F.size(a) == 0) | (F.size(b) == 0) | (a == b)


def _by_names(value: Column, names: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, to in names.items():
        found = F.when(value == name, F.lit(to)).otherwise(found)
    return found


def _by_rules(text: Column, rules: tuple) -> Column:
    found = F.lit(None).cast("string")
    for markers, also, state in reversed(rules):
        test = any_of(text, markers)
        found = F.when(test if also is None else test & any_of(text, also), F.lit(state)).otherwise(found)
    return found


def status_from_statement(text: Column) -> Column:
    """The task state that a statement says: plans before results."""
    return _by_rules(F.coalesce(text, F.lit("")), STATEMENT_STATES)


def status_from_contract(value: Column, source: Column) -> Column:
    """The task state that a value names, else that its source says: results before work under way."""
    value = T.squeeze(value)
    found = _by_rules(F.coalesce(source, F.lit("")), CONTRACT_STATES)
    for state, names in STATE_ALIASES.items():
        found = F.when(F.lower(value).isin(*names) | value.isin(*names), F.lit(state)).otherwise(found)
    return found


def legacy_status(value: Column) -> Column:
    """A stored state as one of todo and done; any other is an error."""
    low = F.lower(F.trim(value))
    for old, new in LEGACY_STATES.items():
        low = F.when(low == old, F.lit(new)).otherwise(low)
    return F.when(low.isNull() | low.isin("todo", "done"), low).otherwise(F.raise_error(F.concat(F.lit("invalid task_status: "), value)).cast("string"))


def consistency(question: Column) -> Column:
    """What a question has to be consistent with: memory, note or weak."""
    value = T.casefold(T.squeeze(question))
    return F.when(any_of(value, MEMORY_QUESTIONS), "memory").when(any_of(value, NOTE_QUESTIONS), "note").otherwise("weak")


def expected_type(query: Column) -> Column:
    """The memory type that a question expects; null where it expects none or several."""
    query = F.coalesce(query, F.lit(""))
    tests = {"preference": any_of(query, ASKS_PREFERENCE), "task": any_of(query, ASKS_TASK) | (any_of(query, ASKS_STATUS) & ~any_of(query, NOT_STATUS)), "semantic": any_of(query, ASKS_SEMANTIC)}
    n = sum((t.cast("int") for t in tests.values()), F.lit(0))
    found = F.lit(None).cast("string")
    for name, test in tests.items():
        found = F.when((n == 1) & test, F.lit(name)).otherwise(found)
    return found


def rejection(content: Column, note: Column, should_store: Column, reason: Column, confidence: Column, evidence: Column) -> Column:
    """Why a candidate is refused, by the first rule that holds; null for one that passes."""
    content = T.squeeze(content)
    key = T.normalize_content(content)
    low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(confidence) | (F.abs(confidence) == float("inf")), 0.0).otherwise(confidence)))
    span = F.trim(F.coalesce(evidence, F.lit("")))
    worthless = (F.length(key) <= 2) | key.isin(*LOW_VALUE_TEXTS)
    return (
        F.when(~should_store, F.coalesce(F.nullif(reason, F.lit("")), F.lit("candidate_should_not_store"))).when(worthless, "low_value_content").when(is_sensitive(note) | is_sensitive(content), "sensitive_data")
        .when(low < MIN_CONFIDENCE, "confidence_below_minimum").when((span != "") & ~F.contains(F.coalesce(note, F.lit("")), span), "evidence_span_not_grounded")
    )


def validated(candidates: DataFrame) -> DataFrame:
    """`candidates` with rejection_reason and content clipped: the rules, then repeats of a note's earlier ones.

    `candidates` has note_id, at, memory_type, content, note_text, should_store, reason, confidence and evidence_span.
    """
    why = rejection(*[F.col(c) for c in ("content", "note_text", "should_store", "reason", "confidence", "evidence_span")])
    rows = candidates.withColumns({"rejection_reason": why, "content": F.substring(T.squeeze(F.col("content")), 1, 1000)})
    same = Window.partitionBy("note_id", "memory_type", T.normalize_content(F.col("content")), F.col("rejection_reason").isNull()).orderBy("at")
    again = F.col("rejection_reason").isNull() & (F.row_number().over(same) > 1)
    return rows.withColumn("rejection_reason", F.when(again, "duplicate_candidate").otherwise(F.col("rejection_reason")))
