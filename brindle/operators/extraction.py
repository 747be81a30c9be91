"""Candidates for memories from messages, by rules: clauses, then none to several typed candidates of each.

A message is one row; its clauses and their candidates are arrays of that row until they are exploded,
so nothing is shuffled but the candidates themselves, to drop repeats within a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import facets, identity, keys, preference, rules
from brindle.functions import text as T
from brindle.functions.preference import strip
from brindle.functions.sensitive import is_sensitive

# Markers of preferences, tasks and facts.
PREFERENCE_MARKERS = ("喜欢", "不喜欢", "更喜欢", "讨厌", "厌恶", "不爱", "偏好", "偏向", "习惯", "不想", "不打算", "暂时不", "只学", "重点放在", "过敏")
TASK_MARKERS = (
    "记得", "需要", "待办", "todo", "跟进", "修", "改", "实现", "完成", "提交", "上线", "取消", "不做了", "不用做", "放弃", "等待", "还在等", "提醒",
    "准备", "计划", "报名", "开始", "处理", "继续做", "补充", "卡住", "阻塞", "暂停",
)
SEMANTIC_MARKERS = ("正在", "重点", "学习", "研究", "开发", "负责", "住在", "搬到", "使用", "采用")
STATED_FACTS = ("重点放在", "主要使用", "正在开发", "负责")
UNDER_WAY = "正在[^，,。！？!?；;]*(?:测试|处理|补充|开发|完善|修复)"
DAYS, EVENTS, STARTED = ("今天", "昨天", "前天", "刚才"), ("参加", "去了", "面试", "讨论"), "开始处理"
EPISODE_MARKERS, EPISODE_TESTS = ("今天", "昨天", "刚才", "参加", "去了", "发布"), ("今天", "昨天", "刚才", "完成了", "去了", "参加", "发布")
LIKING, DOING = ("喜欢", "偏好", "不喜欢", "更喜欢"), ("要", "需要", "报名", "完成", "待办", "计划")
# States and operations of a statement about a task's course, and what makes learning a task.
STATE_WORDS = ("记得", "需要", "待办", "正在", "进行中", "已经", "完成", "完成了", "做完", "学完", "已学完", "取消", "阻塞")
TASK_OPERATIONS = ("学习", "学完", "学", "换成", "更换", "换", "替换", "迁移", "制作", "做完", "做", "开发", "实现", "修复", "完善", "修改", "处理", "维护", "执行", "部署", "发布")
LEARNING_TASK = ("记得", "需要", "待办", "任务", "计划", "准备", "完成", "做完")
# What is taken from the ends of a message, and how a guess begins.
FILLERS_START, ASIDE_START, ASIDE_END = r"^(?:嗯|呃|那个|，|,|…|\s)+", r"^(?:先忽略前面的闲聊|总之)[，,]?\s*", r"(?:，|,)?\s*(?:先别急|别急)[。！？!?]*$"
GUESS_START = "^(?:(?:我|本人|用户)?(?:现在|目前|后续|接下来|之后)?)(?:可能|也许|大概|好像|猜一下)"
SUBJECT_START, OWNER_START = "(?i)^(记得|需要|待办|todo[:：]?|帮我记一下|提醒我)", "^(我|本人|用户)"
# Preferences for several objects, what keeps them together, and how many there may be.
OBJECTS, SCOPE_WORDS, BETWEEN = r"((?:不|更)?(?:喜欢|偏好|偏向|讨厌|不爱))\s*([^，,。；;]+)", ("工作日", "早上", "晚上", "时候", "情况下"), r"\s*(?:、|和|以及)\s*"
MOST_OBJECTS, OBJECT_LENGTH, EPISODE_LENGTH, MOST_ENTITIES = 6, 32, 12, 8
# Names of things, and things named by their words.
ENTITY, ENTITY_WORDS = r"[A-Za-z][A-Za-z0-9+#.-]*", ("咖啡", "牛奶", "苹果", "北京", "上海", "Java", "Python", "Agent", "RAG", "README", "CI")
LIVING, LEARNING, PROJECTS, CITIES = ("住在", "搬到", "居住"), ("学习", "只学", "重点", "研究"), ("开发", "负责", "项目"), ("北京", "上海")
# Words that refer to something said before, texts that are nothing but that, and what a task said before has and has not.
REFERS = "(?:这个|那个|它|这件事|上面那个|继续做|也(?:做完|完成)|取消它|就按这个|又|再次|仍然|后续|后来)"
ONLY_REFERS = "^(?:这个|那个|它|这件事|上面那个)(?:继续做?|继续|做下去|完成它|也(?:做完|完成)了?|取消它|就按这个)(?:吧)?$"
TASK_SAID, NO_TASK_SAID = ("任务", "待办", "完成", "做完", "继续", "处理", "评测", "开发", "修改", "修复", "实现", "准备", "计划"), "(?:整理学习计划|讨论了其他任务)"
LOOK_BACK, REFERENCE_CONFIDENCE = 3, 0.82
# Importance and confidence of each type.
WEIGHTS = {"preference": (0.75, 0.86), "task": (0.8, 0.82), "semantic": (0.78, 0.84), "episodic": (0.55, 0.72)}
REASONS = {"preference": "preference_marker", "task": "task_marker", "semantic": "semantic_marker", "episodic": "episodic_event"}
ORDER = ("preference", "task", "semantic", "episodic")


def is_worthless(text: Column) -> Column:
    """A greeting, a text of two characters or fewer, or one with sensitive data."""
    compact = T.casefold(F.regexp_replace(text, r"\s+", ""))
    return compact.isin(*rules.LOW_VALUE_PATTERNS) | (F.length(compact) <= 2) | is_sensitive(text)


def entities(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    words = F.filter(F.array(*[F.lit(w) for w in ENTITY_WORDS]), lambda w: F.contains(text, w) & ~F.array_contains(found, w))
    return F.slice(F.concat(found, words), 1, MOST_ENTITIES)


def clean_subject(text: Column) -> Column:
    """A statement without the words that ask to note it and without its owner."""
    value = strip(F.regexp_replace(strip(text), SUBJECT_START, ""), " ：:")
    return F.coalesce(F.nullif(strip(F.regexp_replace(value, OWNER_START, ""), " ：:"), F.lit("")), strip(text))


def is_task_course(text: Column) -> Column:
    """Whether a text says how a task goes; learning counts only where it is put as a task."""
    learning = F.contains(text, F.lit("学习")) & ~T.mentions(text, LEARNING_TASK)
    return ~learning & T.mentions(text, STATE_WORDS) & T.mentions(text, TASK_OPERATIONS)


def preference_spans(text: Column) -> Column:
    """The pieces of evidence of a preference: one an object where independent ones are listed, else the whole."""

    def split(m: Column) -> Column:
        parts = F.filter(F.transform(F.split(m["objects"], BETWEEN), lambda p: strip(p)), lambda p: p != "")
        apart = (m["marker"] != "") & ~T.mentions(m["objects"], SCOPE_WORDS) & F.size(parts).between(2, MOST_OBJECTS) & ~F.exists(parts, lambda p: F.length(p) > OBJECT_LENGTH)
        spans = F.filter(F.transform(parts, lambda p, i: F.when(i == 0, F.concat(m["marker"], p)).otherwise(p)), lambda s: F.contains(text, s))
        return F.when(apart & (F.size(spans) > 0), spans).otherwise(F.array(text))

    return T.let(F.struct(F.regexp_extract(text, OBJECTS, 1).alias("marker"), strip(F.regexp_extract(text, OBJECTS, 2)).alias("objects")), split)


def clause_candidates(text: Column, index: Column) -> Column:
    """Of one clause the array of its candidates: memory_type, content, evidence_span, task_status, polarity."""

    def of(raw: Column) -> Column:
        low = T.casefold(raw)
        liked = T.mentions(raw, PREFERENCE_MARKERS)
        task = T.mentions(low, TASK_MARKERS) | raw.rlike(UNDER_WAY) | is_task_course(raw)
        event = T.mentions(raw, EVENTS) | (T.mentions(raw, DAYS) & F.contains(raw, F.lit("完成")) & ~F.contains(raw, F.lit(STARTED)))
        fact = (~liked | T.mentions(raw, STATED_FACTS)) & ~task & ~event & (T.mentions(raw, SEMANTIC_MARKERS) | F.contains(raw, F.lit("项目")) | raw.rlike("|".join(rules.SHORT_FACT_PATTERNS)))
        episode = (event | ~task) & ((F.length(raw) >= EPISODE_LENGTH) | index.isNotNull() | T.mentions(raw, EPISODE_MARKERS)) & T.mentions(raw, EPISODE_TESTS)
        owned = F.regexp_replace(raw, r"^(?:我|本人|用户)\s*", "")
        none = F.lit(None).cast("string")

        def made(kind: str, content: Column, evidence: Column, status: Column = none, sign: Column = none) -> Column:
            return F.struct(F.lit(kind).alias("memory_type"), content.alias("content"), evidence.alias("evidence_span"), status.alias("task_status"), sign.alias("polarity"))

        whole = T.let(rules.polarity(raw), lambda sign: F.transform(preference_spans(raw), lambda s: made("preference", F.concat(F.lit("用户"), clean_subject(s)), s, none, F.when(rules.polarity(s) == "unknown", sign).otherwise(rules.polarity(s)))))
        one = lambda test, c: F.when(test, F.array(c)).otherwise(F.array().cast(whole_type))
        whole_type = "array<struct<memory_type:string,content:string,evidence_span:string,task_status:string,polarity:string>>"
        return F.concat(
            F.when(liked, whole.cast(whole_type)).otherwise(F.array().cast(whole_type)),
            one(task & ~event, made("task", clean_subject(raw), raw, F.coalesce(rules.status_from_statement(raw), F.lit("todo"))).cast(whole_type[6:-1])),
            one(fact, made("semantic", F.concat(F.lit("用户"), clean_subject(raw)), owned).cast(whole_type[6:-1])),
            one(episode, made("episodic", raw, owned).cast(whole_type[6:-1])),
        )

    text = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(text), FILLERS_START, ""), ASIDE_START, ""), ASIDE_END, ""))
    guess = lambda raw: F.regexp_replace(raw, r"\s+", "").rlike(GUESS_START)
    return T.let(text, lambda raw: F.when((raw != "") & ~guess(raw), of(raw)))


def structured(kind: Column, evidence: Column, topic: Column) -> Column:
    """A struct of subject, predicate and object of a candidate."""
    cleaned = clean_subject(evidence)

    def of(found: Column) -> Column:
        names = F.coalesce(F.nullif(F.array_join(found, " "), F.lit("")), cleaned)
        cities = F.filter(found, lambda e: e.isin(*CITIES))
        place = F.coalesce(F.try_element_at(cities, F.lit(-1)), F.try_element_at(found, F.lit(-1)), cleaned)
        row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object_value"))
        user = F.lit("用户")
        fact = F.when(T.mentions(evidence, LIVING), row(user, "location", place)).when(T.mentions(evidence, LEARNING), row(user, "learning", names)).when(T.mentions(evidence, PROJECTS), row(user, "project", names)).otherwise(row(user, "other", cleaned))
        liked = row(user, "preference", F.coalesce(F.nullif(topic, F.lit("")), cleaned))
        return F.when(kind == "preference", liked).when(kind == "task", row(F.coalesce(F.get(found, F.lit(0)), cleaned), "task", cleaned)).when(kind == "semantic", fact).otherwise(row(user, "event", cleaned))

    return T.let(entities(evidence), of)


def extract(messages: DataFrame) -> DataFrame:
    """Candidates of `messages` (note_id, text): one row each, in the order of clauses and types.

    Messages without a candidate give no row; a null text is empty.  Of candidates of a message with one
    type, key and evidence the first stays.  `clause_index`, `clause_start` and `clause_end` place the
    clause in the message's text without its fillers; a message of one clause has none.
    """
    raw = strip(F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(F.regexp_replace("raw", FILLERS_START, ""), ASIDE_START, "")
    rows = messages.select("note_id", raw.alias("raw")).where((F.col("raw") != "") & ~is_worthless(F.col("raw")))
    rows = rows.select("note_id", bare.alias("raw")).withColumn("spans", T.clause_spans(F.col("raw")))
    single = F.array(F.struct(F.lit(None).cast("int").alias("index"), F.regexp_replace("raw", "[。！？!?；;]+$", "").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("event")))
    # A message of one clause with all three kinds of markers is read once more for what happened.
    mixed = T.mentions(F.col("raw"), EPISODE_MARKERS) & T.mentions(F.col("raw"), LIKING) & T.mentions(F.col("raw"), DOING)
    again = F.filter(F.transform("spans", lambda c: F.struct(c["index"], c["text"], c["start"], c["end"], F.lit(True).alias("event"))), lambda c: mixed & T.mentions(c["text"], EPISODE_MARKERS))
    each = F.transform("spans", lambda c: F.struct(c["index"], c["text"], c["start"], c["end"], F.lit(False).alias("event")))
    clauses = rows.select("note_id", F.posexplode(F.when(F.size("spans") > 1, each).otherwise(F.concat(single, again))).alias("at", "c")).where(~is_worthless(F.col("c.text")))
    found = clauses.select("note_id", "at", "c", F.posexplode(clause_candidates(F.col("c.text"), F.col("c.index"))).alias("place", "k")).where(~F.col("c.event") | (F.col("k.memory_type") == "episodic"))
    found = found.select("note_id", "at", "place", F.col("c.index").alias("clause_index"), F.col("c.start").alias("clause_start"), F.col("c.end").alias("clause_end"), "k.*")
    liked = F.col("memory_type") == "preference"
    found = found.withColumn("sig", F.when(liked, preference.signature(F.col("evidence_span"))))
    found = found.withColumn("fields", structured(F.col("memory_type"), F.col("evidence_span"), F.col("sig.topic")))
    value = lambda i: sum((F.when(F.col("memory_type") == k, F.lit(w[i])).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    key = keys.memory_key(F.col("memory_type"), F.col("fields.subject"), F.col("fields.predicate"), F.col("fields.object_value"), F.col("content"))
    task = F.col("memory_type") == "task"
    course = facets.progress(F.col("evidence_span"))
    found = found.withColumns(
        {
            "importance": value(0), "confidence": value(1), "reason": rules._by_names(F.col("memory_type"), REASONS), "entities": entities(F.col("evidence_span")),
            "scope": F.when(liked, F.coalesce(F.get("sig.scopes", F.lit(0)), F.lit("global"))), "family": F.when(liked, preference.family(F.col("sig.topic"), F.col("evidence_span"))), "qualifiers": F.col("sig.qualifiers"),
            "blocker": F.when(task, course["blocker"]), "progress_note": F.when(task, course["progress_note"]), "closure_reason": F.when(task & (F.col("task_status") == "done"), facets.closure_reason(F.lit(None).cast("string"), F.col("evidence_span"))),
            "memory_key": key,
        }
    )
    given = F.when(F.col("clause_index").isNotNull(), keys.evidence_id(F.col("note_id"), F.col("clause_index"), F.col("memory_type"), F.col("memory_key"), F.col("evidence_span"), F.col("content")))
    found = found.withColumn("candidate_id", F.coalesce(given, keys.candidate_id(F.col("note_id"), F.col("memory_type"), F.col("content"))))
    same = Window.partitionBy("note_id", "memory_type", "memory_key", "evidence_span").orderBy("at", "place")
    found = found.withColumn("again", F.row_number().over(same)).where("again = 1")
    return found.select("note_id", "candidate_id", "clause_index", "clause_start", "clause_end", "memory_type", "content", "evidence_span", "task_status", "polarity", "importance", "confidence", "reason", "entities", "fields.subject", "fields.predicate", "fields.object_value", "scope", "family", "qualifiers", "blocker", "progress_note", "closure_reason", "memory_key")


def canonical(candidates: DataFrame) -> DataFrame:
    """`candidates` of `extract` under canonical identities: subject, predicate, object, scope, topic, operation,
    values, family and key follow from the evidence alone, so that wordings of one thing meet in one key."""
    said, kind = F.coalesce(F.nullif(F.col("evidence_span"), F.lit("")), F.col("content")), F.col("memory_type")
    rows = candidates.withColumn("said", said)
    of = lambda name, made: F.when(kind == name, made)
    said = F.col("said")
    rows = rows.withColumns(
        {
            "t": of("task", identity.task(said, F.col("predicate"), F.col("scope"))), "v": of("task", identity.replaced_values(said)), "p": of("preference", identity.preference_identity(preference.signature(said), said, F.col("subject"), F.col("scope"))),
            "s": of("semantic", identity.fact_identity(F.col("predicate"), said, F.col("subject"))), "e": of("episodic", identity.event_identity(said, F.col("object_value"), F.col("subject"))),
        }
    )
    status = F.when(kind == "task", F.coalesce(rules.status_from_contract(F.col("task_status"), said), F.lit("todo")))
    closed = F.when((kind == "task") & (status == "done"), F.coalesce(facets.closure_reason(F.lit(None).cast("string"), said), F.col("closure_reason")))
    return rows.withColumns(
        {
            "subject": F.lit("用户"), "predicate": F.when(kind == "task", F.col("t.predicate")).when(kind == "semantic", F.col("s.attribute")).when(kind == "episodic", F.lit("event")).otherwise(F.col("predicate")),
            "object_value": F.when(kind == "task", F.coalesce("v.new_value", "object_value", "t.predicate")).when(kind == "preference", F.col("p.topic")).when(kind == "episodic", F.col("e.topic")).otherwise(F.col("object_value")),
            "scope": F.when(kind == "preference", F.col("p.scope")).when(kind == "task", F.coalesce("scope", F.lit("global"))).when(kind == "semantic", F.lit("current")).otherwise(F.lit("history")),
            "operation": F.col("t.operation"), "topic": F.coalesce("t.topic", "p.topic", "e.topic"), "old_value": F.col("v.old_value"), "new_value": F.col("v.new_value"), "family_key": F.coalesce("t.family_key", "p.family_key"),
            "memory_key": F.coalesce("t.memory_key", "p.memory_key", "s.memory_key", "e.memory_key"), "task_status": status, "closure_reason": closed,
        }
    ).drop("t", "v", "p", "s", "e", "said")


def antecedents(messages: DataFrame) -> DataFrame:
    """What each message of `messages` (note_id, space, at, role, text) refers to: note_id, reference_status,
    antecedent_note_id, antecedent_offset, antecedent_text, only_refers.

    A message with a referring word looks back on the LOOK_BACK newest messages before it in its space
    that a user wrote, not empty and not sensitive.  If exactly one of them speaks of a task, that is what
    it refers to (resolved); with several or none it is unresolved, without such messages or such a word
    not_applicable.  Messages and those they look back on meet by number: each carries the count of usable
    messages before it, so the join is on equal places in a space.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("note_id", "space", "at", text.alias("text"), ((F.lower(F.coalesce("role", F.lit("user"))) == "user") & ~is_sensitive(text) & (strip(text) != "")).alias("usable"))
    earlier = Window.partitionBy("space").orderBy("at", "note_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.coalesce(F.sum(F.col("usable").cast("int")).over(earlier), F.lit(0)))
    said = rows.where("usable").select("space", (F.col("n") + 1).alias("place"), F.col("note_id").alias("said_id"), strip(F.col("text")).alias("said"))
    task = T.mentions(F.col("said"), TASK_SAID) & ~F.col("said").rlike(NO_TASK_SAID)
    asking = rows.where(F.col("text").rlike(REFERS) & (F.col("n") > 0)).select("note_id", "space", "n", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(LOOK_BACK)).cast("int"))).alias("back"))
    met = asking.withColumn("place", F.col("n") - F.col("back") + 1).join(said, ["space", "place"]).groupBy("note_id").agg(F.count_if(task).alias("tasks"), F.max(F.when(task, F.struct("said_id", (-F.col("back")).alias("offset"), "said"))).alias("one"))
    one = F.col("tasks") == 1
    status = F.when(one, "resolved").when(F.col("tasks").isNotNull(), "unresolved").otherwise("not_applicable")
    bare = F.regexp_replace("text", r"[\s。！？!?；;，,]+", "")
    return rows.join(met, "note_id", "left").select(
        "note_id", status.alias("reference_status"), F.when(one, F.col("one.said_id")).alias("antecedent_note_id"), F.when(one, F.col("one.offset")).alias("antecedent_offset"), F.when(one, F.col("one.said")).alias("antecedent_text"), bare.rlike(ONLY_REFERS).alias("only_refers")
    )


def with_references(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Canonical candidates after their `antecedents`: a task that refers to one said before takes its key,
    topic, family and names; a task of a text that only refers, to nothing certain, goes."""
    task = F.col("memory_type") == "task"
    rows = candidates.join(found, "note_id", "left")
    rows = rows.where(~task | ~(F.coalesce("only_refers", F.lit(False)) & (F.col("reference_status") == "unresolved")) | F.col("reference_status").isNull())
    known = task & F.coalesce(F.col("reference_status") == "resolved", F.lit(False))
    rows = rows.withColumn("i", F.when(known, identity.task(F.col("antecedent_text"), F.lit("task"), F.lit("global"))))
    taken = {"subject": "i.subject", "predicate": "i.predicate", "object_value": "i.predicate", "operation": "i.operation", "topic": "i.topic", "family_key": "i.family_key", "memory_key": "i.memory_key"}
    rows = rows.withColumns({c: F.when(known, F.col(x)).otherwise(F.col(c)) for c, x in taken.items()})
    return rows.withColumn("resolution_confidence", F.when(known, F.lit(REFERENCE_CONFIDENCE))).drop("i", "only_refers")
