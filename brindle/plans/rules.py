"""Driver queries for rules on texts, over statements and document texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import facets as A
from brindle.functions import keys as K
from brindle.functions import routes as G
from brindle.functions import rules as R
from brindle.functions import terms as M
from brindle.functions import text as T
from brindle.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Statements that the document tables do not have; a row's number chooses one.
STATEMENTS = (
    "我喜欢喝咖啡，不喜欢牛奶", "TASK-12 准备这周提交 README", "今天很焦虑。要学习新课程", "我是不是喜欢跑步？", "已经换成新的电脑", "好的", "暂时不吃苹果但喜欢香蕉", "提醒我明天完成 X1-2 报告",
    "正在修复登录问题 API.v2", "我姓王", "有什么灵感 可以做", "http://a.b/c 收藏", "当前待办有哪些", "最近的笔记", "我的任务状态是什么状态", "取消 PROJ-7", "我在北京工作", "我讨厌下雨，喜欢晴天", "偏好是什么", "what do I like about TODO 2.5",
)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_sql(expr: str, markers) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{m}')" for m in markers) + ")"


_S = f"s AS (SELECT doc_id, {_list(STATEMENTS)}[(doc_id % {len(STATEMENTS)})::INT + 1] AS t FROM documents)"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.col("doc_id") % len(STATEMENTS) + 1).cast("int")).alias("t"))


_TAGS_OF = "CASE ty " + " ".join(f"WHEN '{k}' THEN {_list(v + R.GLOBAL_TAGS)}" for k, v in R.TYPE_TAGS.items()) + " END"
_MOOD = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{m}'" for m in R.TYPE_TAGS["情绪"]) + " ELSE '困惑' END"


@query(f"""WITH {_S}, y AS (SELECT *, lower(t) AS low, CASE WHEN {any_sql("lower(t)", R.TASK_WORDS)} THEN '任务' WHEN {any_sql("t", R.MOOD_WORDS)} THEN '情绪' WHEN {any_sql("lower(t)", R.STUDY_WORDS)} THEN '学习'
    WHEN {any_sql("t", R.IDEA_WORDS)} THEN '灵感' WHEN {any_sql("lower(t)", ("http://", "https://"))} OR {any_sql("t", R.SOURCE_WORDS)} THEN '资料' ELSE '生活' END AS ty FROM s),
    g AS (SELECT *, CASE ty WHEN '任务' THEN ['待办', '提醒'] WHEN '情绪' THEN [{_MOOD}, '日常'] WHEN '学习' THEN ['笔记', '知识点'] WHEN '灵感' THEN ['创意', '想法'] WHEN '资料' THEN ['备查', '收藏']
      ELSE CASE WHEN {any_sql("t", R.FOOD_WORDS)} THEN ['饮食', '日常'] WHEN {any_sql("t", R.SPORT_WORDS)} THEN ['运动', '日常'] ELSE ['日常', '长期'] END END AS raw, list_filter({_TAGS_OF}, lambda x: x <> ty) AS ok FROM y),
    k AS (SELECT *, list_filter(raw, lambda x: list_contains(ok, x)) AS kept FROM g)
    SELECT doc_id, ty AS type, array_to_string(CASE WHEN len(kept) >= 2 THEN kept ELSE list_concat(kept, list_slice(list_filter(ok, lambda x: NOT list_contains(kept, x)), 1, 2 - len(kept))) END, ',') AS tags,
      substr(regexp_split_to_array(t, '[。！？]')[1], 1, 20) AS title, substr(t, 1, 120) AS summary FROM k""")
def rule_classes(spark: SparkSession, d: str) -> DataFrame:
    found = _statements(spark, d).select("doc_id", R.classify(F.col("t")).alias("c"))
    return found.select("doc_id", "c.type", F.array_join("c.tags", ",").alias("tags"), "c.title", "c.summary")


_SHORT = "|".join(R.SHORT_FACT_PATTERNS)


@query(f"""WITH {_S} SELECT doc_id, NOT (lower(regexp_replace(t, '\\s+', '', 'g')) IN ({_list(R.LOW_VALUE_PATTERNS)[1:-1]}) OR length(regexp_replace(t, '\\s+', '', 'g')) <= 2)
    AND ({any_sql("t", R.MEMORY_MARKERS)} OR regexp_matches(t, '{_SHORT}') OR length(t) >= 24) AS may_hold FROM s""")
def memory_gate(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d).select("doc_id", R.may_hold_memory(F.col("t")).alias("may_hold"))


def _place(markers) -> str:
    return "least(" + ", ".join(f"nullif(instr(t, '{m}'), 0)" for m in markers) + ")"


@query(f"""WITH {_S}, p AS (SELECT *, least({_place(R.NEGATIVE_MARKERS)}, CASE WHEN regexp_matches(t, '{R.NEGATED_ACTION}') THEN length(regexp_extract(t, '^(.*?){R.NEGATED_ACTION}', 1)) + 1 END) AS neg, {_place(R.POSITIVE_MARKERS)} AS pos FROM s),
    q AS (SELECT *, CASE WHEN neg IS NOT NULL AND (pos IS NULL OR neg <= pos) THEN 'negative' WHEN pos IS NOT NULL THEN 'positive' ELSE 'unknown' END AS polarity FROM p)
    SELECT doc_id, polarity, CASE WHEN {any_sql("t", ("?", "？"))} OR ({any_sql("t", R.HABIT_WORDS)} AND {any_sql("t", R.HABIT_QUESTIONS)}) OR regexp_matches(t, '{R.ASKING_OWNER}')
      OR regexp_matches(regexp_replace(t, '[。！!]+$', ''), '{R.ASKING_END}') OR {" OR ".join(f"starts_with(lower(t), '{w}')" for w in R.ASKING_START)} THEN 'unknown' ELSE polarity END AS query_polarity FROM q""")
def preference_polarity(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d).select("doc_id", R.polarity(F.col("t")).alias("polarity"), R.query_polarity(F.col("t")).alias("query_polarity"))


def _states(rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql('t', a)}{'' if b is None else ' AND ' + any_sql('t', b)} THEN '{state}'" for a, b, state in rules) + " END"


_ALIAS = "CASE " + " ".join(f"WHEN lower(v) IN ({_list(names)[1:-1]}) THEN '{state}'" for state, names in R.STATE_ALIASES.items())


@query(f"""WITH {_S}, v AS (SELECT *, ['blocked', 'Done', '放弃', 'other'][(doc_id % 4)::INT + 1] AS v FROM s) SELECT doc_id, {_states(R.STATEMENT_STATES)} AS by_statement, {_ALIAS} ELSE {_states(R.CONTRACT_STATES)} END AS by_contract,
    array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(t, '{R.TASK_TOKEN_PATTERN}'), lambda x: regexp_matches(x, '[0-9#._-]') OR x = upper(x)), lambda x: lower(x)))), ',') AS identifiers FROM v""")
def task_states(spark: SparkSession, d: str) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(v) for v in ("blocked", "Done", "放弃", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    t = F.col("t")
    return _statements(spark, d).select("doc_id", R.status_from_statement(t).alias("by_statement"), R.status_from_contract(named, t).alias("by_contract"), F.array_join(R.task_identifiers(t), ",").alias("identifiers"))


@query(f"""WITH {_S}, c AS (SELECT *, {any_sql("t", R.ASKS_PREFERENCE)} AS p, {any_sql("t", R.ASKS_TASK)} OR ({any_sql("t", R.ASKS_STATUS)} AND NOT {any_sql("t", R.NOT_STATUS)}) AS k, {any_sql("t", R.ASKS_SEMANTIC)} AS f FROM s)
    SELECT doc_id, CASE WHEN {any_sql("lower(t)", R.MEMORY_QUESTIONS)} THEN 'memory' WHEN {any_sql("lower(t)", R.NOTE_QUESTIONS)} THEN 'note' ELSE 'weak' END AS consistency,
    CASE WHEN p::INT + k::INT + f::INT <> 1 THEN NULL WHEN p THEN 'preference' WHEN k THEN 'task' ELSE 'semantic' END AS expected FROM c""")
def question_classes(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d).select("doc_id", R.consistency(F.col("t")).alias("consistency"), R.expected_type(F.col("t")).alias("expected"))


def norm_sql(x: str) -> str:
    out = f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    for w in T.OWNER_WORDS:
        out = f"replace({out}, '{w}', '')"
    return out


def topic_sql(x: str) -> str:
    out = f"replace(lower({x}), 'ß', 'ss')"
    for w in sorted(T.QUERY_FILLERS, key=len, reverse=True):
        out = f"replace({out}, '{w}', ' ')"
    for p in T.TOPIC_PATTERNS:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_NAMED = "list_distinct(list_transform(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]+-\\d+|[A-Za-z][A-Za-z0-9+#._-]*|\\d+(?:[._-]\\d+)*'), lambda n: lower(n)))"
_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: flatten(list_transform([4, 3, 2], lambda w: list_transform(range(1, greatest(length(r) - w + 2, 1)), lambda i: substr(r, i, w)))))))"
_SHARE = "CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE ELSE 0 END"


def overlap_sql(pairs: str, q: str, t: str) -> str:
    """Common table expressions that end in `ov`: the rows of `pairs` with the overlap of two columns."""
    return f"""ov1 AS (SELECT *, {topic_sql(q)} AS tq, {topic_sql(t)} AS tc FROM {pairs}),
    ov2 AS (SELECT *, {norm_sql("tq")} AS nq, {norm_sql("tc")} AS nc, {_NAMED.format(x="tq")} AS aq, {_NAMED.format(x="tc")} AS ac, {_GRAMS.format(x="tq")} AS gq, {_GRAMS.format(x="tc")} AS gc FROM ov1),
    ov3 AS (SELECT *, {_SHARE.format(a="aq", b="ac")} AS sn, {_SHARE.format(a="gq", b="gc")} AS sg, least(length(nq), length(nc)) AS la, greatest(length(nq), length(nc)) AS lb FROM ov2),
    ov AS (SELECT *, CASE WHEN nq = '' OR nc = '' THEN 0 WHEN nq = nc THEN 1 WHEN la >= 2 AND (contains(nq, nc) OR contains(nc, nq)) THEN least(1.0::DOUBLE, 0.82::DOUBLE + 0.18::DOUBLE * la / lb::DOUBLE)
      WHEN len(aq) > 0 AND len(gq) > 0 THEN round(0.35::DOUBLE * sn + 0.65::DOUBLE * sg, 4) WHEN len(aq) > 0 THEN round(sn, 4) ELSE round(sg, 4) END::DOUBLE AS overlap FROM ov3)"""


@query(f"""WITH {_S}, q AS (SELECT i, {_list(STATEMENTS)}[i] AS q FROM range(1, {len(STATEMENTS) + 1}) r(i)), p AS (SELECT DISTINCT i, q, t FROM q, (SELECT DISTINCT t FROM s)),
    x AS (SELECT *, {topic_sql("q")} AS tq, {topic_sql("t")} AS tc FROM p), y AS (SELECT *, {norm_sql("tq")} AS nq, {norm_sql("tc")} AS nc, {_NAMED.format(x="tq")} AS aq, {_NAMED.format(x="tc")} AS ac, {_GRAMS.format(x="tq")} AS gq, {_GRAMS.format(x="tc")} AS gc FROM x),
    z AS (SELECT *, {_SHARE.format(a="aq", b="ac")} AS sn, {_SHARE.format(a="gq", b="gc")} AS sg, least(length(nq), length(nc)) AS a, greatest(length(nq), length(nc)) AS b FROM y)
    SELECT i AS query_no, md5(t) AS content, round(CASE WHEN nq = '' OR nc = '' THEN 0 WHEN nq = nc THEN 1 WHEN a >= 2 AND (contains(nq, nc) OR contains(nc, nq)) THEN least(1.0, 0.82 + 0.18 * a / b::DOUBLE)
      WHEN len(aq) > 0 AND len(gq) > 0 THEN 0.35 * sn + 0.65 * sg WHEN len(aq) > 0 THEN sn ELSE sg END::DOUBLE, 4) AS overlap FROM z""")
def overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every statement as a query against every distinct statement of the table."""
    asked = spark.createDataFrame(list(enumerate(STATEMENTS, start=1)), "query_no long, q string")
    pairs = _statements(spark, d).select("t").distinct().crossJoin(F.broadcast(asked))
    return pairs.select("query_no", F.md5(F.col("t").cast("binary")).alias("content"), F.round(T.overlap_score(F.col("q"), F.col("t")), 4).alias("overlap"))


_LEX = "t"
for _w in T.NOTE_FILLERS:
    _LEX = f"replace({_LEX}, '{_w}', '')"
_LEX = _LEX.replace("t", "lower(t)", 1) if _LEX == "t" else _LEX.replace("(t,", "(lower(t),", 1)
_PAIRS = "list_transform(range(1, length(r)), lambda i: substr(r, i, 2))"


@query(f"""WITH {_S}, l AS (SELECT DISTINCT t, {_LEX} AS v FROM s) SELECT md5(t) AS content, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(v, '{T.TERM_PATTERN}'),
    flatten(list_transform(regexp_extract_all(v, '[\\x{{3400}}-\\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE {_PAIRS} END))))), '|') AS terms FROM l""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of every distinct statement as a search for provisional notes."""
    return _statements(spark, d).select("t").distinct().select(F.md5(F.col("t").cast("binary")).alias("content"), F.array_join(F.array_sort(T.lexical_terms(F.col("t"))), "|").alias("terms"))


@query(f"""WITH {_S}, c AS (SELECT doc_id, doc_id // 40 AS note_id, doc_id AS at, ['preference', 'task'][(doc_id % 2)::INT + 1] AS memory_type, t AS content, t || '。' AS note_text, doc_id % 11 <> 0 AS should_store, (doc_id % 10) / 10.0::DOUBLE AS confidence,
      CASE WHEN doc_id % 7 = 0 THEN 'not in it' ELSE substr(t, 1, 4) END AS span FROM s), k AS (SELECT *, {norm_sql("content")} AS key FROM c),
    r AS (SELECT *, CASE WHEN NOT should_store THEN 'candidate_should_not_store' WHEN length(key) <= 2 OR key IN ({_list(R.LOW_VALUE_TEXTS)[1:-1]}) THEN 'low_value_content' WHEN confidence < 0.45 THEN 'confidence_below_minimum'
      WHEN trim(span) <> '' AND NOT contains(note_text, trim(span)) THEN 'evidence_span_not_grounded' END AS why FROM k)
    SELECT doc_id, coalesce(CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY note_id, memory_type, key, (why IS NULL) ORDER BY doc_id) > 1 THEN 'duplicate_candidate' ELSE why END, '') AS rejection_reason FROM r""")
def candidate_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _statements(spark, d).select(
        "doc_id", F.floor(F.col("doc_id") / 40).alias("note_id"), F.col("doc_id").alias("at"), F.element_at(F.array(F.lit("preference"), F.lit("task")), (F.col("doc_id") % 2 + 1).cast("int")).alias("memory_type"), F.col("t").alias("content"),
        F.concat("t", F.lit("。")).alias("note_text"), (F.col("doc_id") % 11 != 0).alias("should_store"), F.lit(None).cast("string").alias("reason"), (F.col("doc_id") % 10 / 10.0).alias("confidence"),
        F.when(F.col("doc_id") % 7 == 0, "not in it").otherwise(F.substring("t", 1, 4)).alias("evidence_span"),
    )
    return R.validated(rows).select("doc_id", F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason"))


_KEY_SQL = {"own": norm_sql("coalesce(nullif(subj, ''), '用户')"), "slot": norm_sql("coalesce(nullif(pred, ''), mt)"), "whole": norm_sql("content"), "value": norm_sql("coalesce(obj, '')")}


@query(f"""WITH {_S}, m AS (SELECT doc_id, ['preference', 'task', 'semantic', 'episodic'][(doc_id % 4)::INT + 1] AS mt, t AS content, ['me', '', '张三'][(doc_id % 3)::INT + 1] AS subj, CASE WHEN doc_id % 2 = 0 THEN 'Drink-Type' END AS pred, CASE WHEN doc_id % 7 = 0 THEN '需要完成测试了' END AS obj FROM s),
    n AS (SELECT *, coalesce(nullif({_KEY_SQL["own"]}, ''), '用户') AS o, coalesce(nullif({_KEY_SQL["slot"]}, ''), mt) AS sl, {_KEY_SQL["whole"]} AS w, {_KEY_SQL["value"]} AS v FROM m),
    k AS (SELECT *, CASE WHEN o IN ('user', 'me', 'myself') THEN 'user' ELSE o END AS own, coalesce(nullif(v, ''), w) AS topic FROM n)
    SELECT doc_id, CASE mt WHEN 'preference' THEN concat_ws(':', 'preference', own, coalesce(nullif(regexp_replace(regexp_replace(topic, '{K.PREFERENCE_WORDS}', '', 'g'), '{K.PREFERENCE_VERBS}', ''), ''), 'unspecified'), 'global')
      WHEN 'task' THEN concat_ws(':', 'task', own, sl, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(topic, '{K.TASK_WORDS}', '', 'g'), '^是+', ''), '了+$', ''), ''), 'unspecified'))
      WHEN 'semantic' THEN concat_ws(':', 'semantic', own, sl, substr(CASE WHEN w <> '' THEN w WHEN v <> '' THEN v ELSE '' END, 1, 96)) ELSE concat_ws(':', mt, own, sl, topic) END AS memory_key,
      sha256(concat_ws('|', mt || ' | ' || subj || ' | ' || coalesce(pred, '') || ' | ' || coalesce(obj, '') || ' | ' || content, 'm', '8', 'v1')) AS content_hash FROM k""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    rows = _statements(spark, d).select("doc_id", at(("preference", "task", "semantic", "episodic"), i).alias("mt"), F.col("t").alias("content"), at(("me", "", "张三"), i).alias("subj"), F.when(i % 2 == 0, "Drink-Type").alias("pred"), F.when(i % 7 == 0, "需要完成测试了").alias("obj"))
    parts = [F.col(c) for c in ("mt", "subj", "pred", "obj", "content")]
    return rows.select("doc_id", K.memory_key(*parts).alias("memory_key"), K.content_hash(K.embedding_text(*parts), "m", 8, "v1").alias("content_hash"))


def _contains_case(rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql('t', (words,) if isinstance(words, str) else words)} THEN '{name}'" for words, name in rules) + " END"


_OPS = [(w, n) for w, n in sorted(A.OPERATIONS.items(), key=lambda x: -len(x[0])) if w not in A.ENDED] + [("完成", "执行")]


@query(f"""WITH {_S} SELECT doc_id, coalesce({_contains_case(A.CLOSING)}, '') AS closure, coalesce({_contains_case(_OPS)}, '') AS operation, coalesce({_contains_case(A.FACTS)}, '') AS attribute FROM s""")
def task_facets(spark: SparkSession, d: str) -> DataFrame:
    none, t = F.lit(None).cast("string"), F.col("t")
    found = {"closure": A.closure_reason(none, t), "operation": A.operation(none, t), "attribute": A.semantic_attribute(none, t)}
    return _statements(spark, d).select("doc_id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in found.items()])


@query()
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    found = _statements(spark, d).select("t").distinct().select("t", G.route(F.col("t")).alias("r"))
    return found.select("t", "r.complexity", "r.confidence", F.array_join("r.strategies", ",").alias("strategies"), F.array_join("r.reasons", ",").alias("reasons"), "r.language", F.array_join("r.intents", ",").alias("intents"), F.array_join("r.time_scopes", ",").alias("time_scopes"))


@query()
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """The bounded terms of every distinct statement as a query for memories and for notes."""
    t = F.col("t")
    return _statements(spark, d).select("t").distinct().select("t", F.array_join(M.memory_terms(t), "|").alias("memory_terms"), F.array_join(M.note_terms(t), "|").alias("note_terms"))
