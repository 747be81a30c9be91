"""Driver queries for candidates from messages, with their SQL.

The messages are the conversations: every text follows a statement that is made of its own words, so
that the rules have something to find in the invented prose; the text itself is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import preference as P
from brindle.functions import rules as R
from brindle.functions import text as T
from brindle.operators import extraction as X
from brindle.plans.relational import SENSITIVE_SQL
from brindle.plans.rules import _list, _states, any_sql, norm_sql
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


#: Statements about three words of a message; a message's place chooses one.
STATEMENTS = (
    "我喜欢{a}和{b}，这周要完成{c}", "昨天参加了{a}的讨论。需要写{b}总结", "正在学习{a}", "讨厌{a}；{b}已经完成", "记得修复{a} {b}", "我姓{a}", "嗯，我住在{a}，主要使用{b}", "{a}项目卡住", "我不喜欢喝{a}而不是{b}",
    "今天去了{a}，更喜欢{b}、{c}以及{a}", "可能会用{a}", "工作日早上喜欢{a}和{b}", "总之，待办{a}-7，提醒我{b}", "暂时不吃{a}，但是喜欢无糖浓{b}",
)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """note_id, space, at, role, text of every turn."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"))
    words = F.regexp_extract_all("body", F.lit(r"(\p{L}{3,12})"), F.lit(1))
    word = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit("abc"))
    said = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), ((F.col("conv_id") * 3 + F.col("turn")) % len(STATEMENTS) + 1).cast("int"))
    said = F.replace(F.replace(F.replace(said, F.lit("{a}"), word(0)), F.lit("{b}"), word(1)), F.lit("{c}"), word(2))
    rows = rows.withColumn("words", words)
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("space"), F.col("turn").alias("at"), "role", F.concat(said, F.lit("。"), "body").alias("text"))


MESSAGES_SQL = f"""ms AS (SELECT conv_id * 1000 + turn AS note_id, conv_id AS space, turn AS seq, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '\\p{{L}}{{3,12}}') AS ws, {_list(STATEMENTS)}[((conv_id * 3 + turn) % {len(STATEMENTS)})::INT + 1] AS st FROM conversations),
    m AS (SELECT note_id, space, seq, replace(replace(replace(st, '{{a}}', coalesce(ws[1], 'abc')), '{{b}}', coalesce(ws[2], 'abc')), '{{c}}', coalesce(ws[3], 'abc')) || '。' || body AS text FROM ms)"""


def _stripped(x: str, marks: str = "\\s") -> str:
    return f"regexp_replace({x}, '^[{marks}]+|[{marks}]+$', '', 'g')"


def _cleaned(x: str) -> str:
    value = _stripped(f"regexp_replace({_stripped(x)}, '{X.SUBJECT_START}', '')", " ：:")
    return f"coalesce(nullif({_stripped(f'regexp_replace({value}, {chr(39)}{X.OWNER_START}{chr(39)}, {chr(39)}{chr(39)})', ' ：:')}, ''), {_stripped(x)})"


def _worthless(x: str) -> str:
    compact = f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
    return f"({compact} IN ({_list(R.LOW_VALUE_PATTERNS)[1:-1]}) OR length({compact}) <= 2 OR {SENSITIVE_SQL.replace('(text, ', f'({x}, ')})"


def _sign(x: str) -> str:
    place = lambda markers: "least(" + ", ".join(f"nullif(instr({x}, '{m}'), 0)" for m in markers) + ")"
    negative = f"least({place(R.NEGATIVE_MARKERS)}, CASE WHEN regexp_matches({x}, '{R.NEGATED_ACTION}') THEN length(regexp_extract({x}, '^(.*?){R.NEGATED_ACTION}', 1)) + 1 END)"
    return f"CASE WHEN {negative} IS NOT NULL AND ({place(R.POSITIVE_MARKERS)} IS NULL OR {negative} <= {place(R.POSITIVE_MARKERS)}) THEN 'negative' WHEN {place(R.POSITIVE_MARKERS)} IS NOT NULL THEN 'positive' ELSE 'unknown' END"


_ANY = lambda markers: any_sql("t", markers)
_WEIGHT = lambda i: "CASE memory_type " + " ".join(f"WHEN '{k}' THEN {w[i]}::DOUBLE" for k, w in X.WEIGHTS.items()) + " END"

EXTRACTED_SQL = f"""{MESSAGES_SQL},
    r AS (SELECT note_id, {_stripped("text")} AS raw FROM m), g AS (SELECT note_id, regexp_replace(regexp_replace(raw, '{X.FILLERS_START}', ''), '{X.ASIDE_START}', '') AS raw FROM r WHERE raw <> '' AND NOT {_worthless("raw")}),
    sp AS (SELECT note_id, raw, list_filter(list_transform(regexp_split_to_array(raw, '[。！？!?；;，,]'), lambda p: trim(regexp_replace({_stripped("p")}, '{T.CONNECTORS}', ''))), lambda p: length(p) > 2)[1:{T.MAX_CLAUSES}] AS cs FROM g),
    cl AS (SELECT note_id, unnest(cs) AS t0, (generate_subscripts(cs, 1) - 1)::INT AS i, false AS ev FROM sp WHERE len(cs) > 1
      UNION ALL SELECT note_id, regexp_replace(raw, '[。！？!?；;]+$', ''), NULL, false FROM sp WHERE len(cs) <= 1
      UNION ALL SELECT note_id, cs[1], 0, true FROM sp WHERE len(cs) = 1 AND {any_sql("raw", X.EPISODE_MARKERS)} AND {any_sql("raw", X.LIKING)} AND {any_sql("raw", X.DOING)} AND {any_sql("cs[1]", X.EPISODE_MARKERS)}),
    tx AS (SELECT note_id, i, ev, {_stripped(f"regexp_replace(regexp_replace(regexp_replace({_stripped('t0')}, '{X.FILLERS_START}', ''), '{X.ASIDE_START}', ''), '{X.ASIDE_END}', '')")} AS t FROM cl WHERE NOT {_worthless("t0")}),
    fl AS (SELECT *, {_ANY(X.PREFERENCE_MARKERS)} AS liked, {any_sql("lower(t)", X.TASK_MARKERS)} OR regexp_matches(t, '{X.UNDER_WAY}') OR (NOT (contains(t, '学习') AND NOT {_ANY(X.LEARNING_TASK)}) AND {_ANY(X.STATE_WORDS)} AND {_ANY(X.TASK_OPERATIONS)}) AS task,
      {_ANY(X.EVENTS)} OR ({_ANY(X.DAYS)} AND contains(t, '完成') AND NOT contains(t, '{X.STARTED}')) AS event, regexp_replace(t, '^(?:我|本人|用户)\\s*', '') AS owned FROM tx WHERE t <> '' AND NOT regexp_matches(regexp_replace(t, '\\s+', '', 'g'), '{X.GUESS_START}')),
    ob AS (SELECT *, regexp_extract(t, '{X.OBJECTS}', 1) AS mk, {_stripped(f"regexp_extract(t, '{X.OBJECTS}', 2)")} AS obj FROM fl),
    pa AS (SELECT *, list_filter(list_transform(regexp_split_to_array(obj, '{X.BETWEEN}'), lambda p: {_stripped("p")}), lambda p: p <> '') AS ps FROM ob),
    sn AS (SELECT *, list_filter(list_transform(ps, lambda p, j: CASE WHEN j = 1 THEN mk || p ELSE p END), lambda s: contains(t, s)) AS sps FROM pa),
    es AS (SELECT *, CASE WHEN mk <> '' AND NOT {any_sql("obj", X.SCOPE_WORDS)} AND len(ps) BETWEEN 2 AND {X.MOST_OBJECTS} AND len(list_filter(ps, lambda p: length(p) > {X.OBJECT_LENGTH})) = 0 AND len(sps) > 0 THEN sps ELSE [t] END AS spans FROM sn),
    ca AS (SELECT note_id, i, t, 'preference' AS memory_type, unnest(spans) AS evidence_span FROM es WHERE liked AND NOT ev
      UNION ALL SELECT note_id, i, t, 'task', t FROM es WHERE task AND NOT event AND NOT ev
      UNION ALL SELECT note_id, i, t, 'semantic', owned FROM es WHERE (NOT liked OR {_ANY(X.STATED_FACTS)}) AND NOT task AND NOT event AND NOT ev AND ({_ANY(X.SEMANTIC_MARKERS)} OR contains(t, '项目') OR regexp_matches(t, '{"|".join(R.SHORT_FACT_PATTERNS)}'))
      UNION ALL SELECT note_id, i, t, 'episodic', owned FROM es WHERE (event OR NOT task) AND (length(t) >= {X.EPISODE_LENGTH} OR i IS NOT NULL OR {_ANY(X.EPISODE_MARKERS)}) AND {_ANY(X.EPISODE_TESTS)}),
    dd AS (SELECT *, row_number() OVER (PARTITION BY note_id, memory_type, evidence_span ORDER BY i NULLS FIRST) AS rn FROM ca),
    ex AS (SELECT note_id, i AS clause_index, memory_type, evidence_span, CASE memory_type WHEN 'preference' THEN '用户' || {_cleaned("evidence_span")} WHEN 'task' THEN {_cleaned("t")} WHEN 'semantic' THEN '用户' || {_cleaned("t")} ELSE t END AS content,
      CASE WHEN memory_type = 'task' THEN coalesce({_states(R.STATEMENT_STATES)}, 'todo') END AS task_status, CASE WHEN memory_type = 'preference' THEN CASE WHEN {_sign("evidence_span")} = 'unknown' THEN {_sign("t")} ELSE {_sign("evidence_span")} END END AS polarity, {_WEIGHT(0)} AS importance, {_WEIGHT(1)} AS confidence FROM dd WHERE rn = 1)"""


@query(f"WITH {EXTRACTED_SQL} SELECT note_id, coalesce(clause_index, -1)::INTEGER AS clause_index, memory_type, evidence_span, content, task_status, polarity, importance, confidence FROM ex")
def extracted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every message."""
    found = X.extract(messages(spark, d))
    return found.select("note_id", F.coalesce("clause_index", F.lit(-1)).alias("clause_index"), "memory_type", "evidence_span", "content", "task_status", "polarity", "importance", "confidence")


_PAIR = lambda k: f"CASE WHEN length({k}) < 2 THEN list_filter([{k}], lambda x: x <> '') ELSE list_distinct(list_transform(range(1, length({k})), lambda i: substr({k}, i, 2))) END"
_WORD = "regexp_extract_all({x}, '\\p{{L}}{{3,12}}')"


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\\p{{L}}{{3,12}}') AS ws FROM conversations), p AS (SELECT conv_id, turn, '我喜欢' || coalesce(ws[1], 'abc') || coalesce(ws[2], 'abc') AS a, '更喜欢' || coalesce(ws[2], 'abc') || coalesce(ws[2 + (turn % 2)::INT], 'abc') AS b, coalesce(ws[1], 'abc') || coalesce(ws[2], 'abc') AS oa,
    coalesce(ws[2], 'abc') || coalesce(ws[2 + (turn % 2)::INT], 'abc') AS ob FROM t), k AS (SELECT *, {norm_sql("oa")} AS ka, {norm_sql("ob")} AS kb, list_sort(list_distinct(list_transform(regexp_extract_all(oa, '[A-Za-z][A-Za-z0-9+#._-]*|\\d+(?:[._-]\\d+)*'), lambda x: lower(x)))) AS na,
    list_sort(list_distinct(list_transform(regexp_extract_all(ob, '[A-Za-z][A-Za-z0-9+#._-]*|\\d+(?:[._-]\\d+)*'), lambda x: lower(x)))) AS nb FROM p),
    q AS (SELECT *, {_PAIR("ka")} AS ga, {_PAIR("kb")} AS gb, CASE WHEN length(ka) <= length(kb) THEN ka ELSE kb END AS sh, CASE WHEN length(ka) <= length(kb) THEN kb ELSE ka END AS lo FROM k),
    j AS (SELECT *, len(list_intersect(ga, gb))::DOUBLE / nullif(len(ga) + len(gb) - len(list_intersect(ga, gb)), 0) AS share, list_count(list_filter(range(1, least(length(ka), length(kb)) + 1), lambda i: right(ka, i) = right(kb, i))) AS tail FROM q)
    SELECT conv_id, turn, ka AS topic_key, CASE WHEN ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 1 WHEN len(na) > 0 OR len(nb) > 0 THEN CASE WHEN na = nb THEN {P.SAME_NAMES} ELSE 0 END WHEN length(sh) >= 2 AND contains(lo, sh) AND length(sh)::DOUBLE / length(lo) >= {P.INSIDE_SHARE} THEN {P.INSIDE}
      WHEN share >= {P.PAIRS_SHARE} THEN round({P.PAIRS} * share, 4) ELSE 0 END::DOUBLE AS compatible, ka <> '' AND kb <> '' AND ka <> kb AND tail >= 2 AND tail::DOUBLE / least(length(ka), length(kb)) >= 0.4 AS alternative FROM j""")
def preference_topics(spark: SparkSession, d: str) -> DataFrame:
    """What two statements of each turn are about, and whether that may be one thing."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}{3,12})"), F.lit(1)).alias("ws"))
    word = lambda i: F.coalesce(F.get("ws", i), F.lit("abc"))
    rows = rows.select("conv_id", "turn", F.concat(F.lit("我喜欢"), word(F.lit(0)), word(F.lit(1))).alias("a"), F.concat(F.lit("更喜欢"), word(F.lit(1)), word((F.col("turn") % 2 + 1).cast("int"))).alias("b"))
    rows = rows.withColumns({"sa": P.signature(F.col("a")), "sb": P.signature(F.col("b"))})
    return rows.select("conv_id", "turn", F.col("sa.key").alias("topic_key"), P.compatibility(F.col("sa"), F.col("sb")).cast("double").alias("compatible"), P.is_alternative(F.col("b"), F.col("sb"), F.col("sa")).alias("alternative"))


#: Statements that refer to tasks said before, and such tasks.
REFERENCES = ("需要完成{a}迁移", "今天看了{b}", "这个也做完了", "继续处理{a}", "这个继续做吧", "{a}后来怎么样", "整理学习计划{b}")


@query(f"""WITH ms AS (SELECT conv_id * 1000 + turn AS note_id, conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '\\p{{L}}{{3,12}}') AS ws, {_list(REFERENCES)}[((conv_id * 5 + turn * 3) % {len(REFERENCES)})::INT + 1] AS st, coalesce(text, '') AS body FROM conversations),
    m AS (SELECT note_id, conv_id, turn, replace(replace(st, '{{a}}', coalesce(ws[1], 'abc')), '{{b}}', coalesce(ws[2], 'abc')) || '。' || body AS text, lower(coalesce(role, 'user')) = 'user' AS by_user FROM ms),
    u AS (SELECT *, by_user AND NOT {SENSITIVE_SQL} AS usable FROM m), n AS (SELECT *, coalesce(sum(usable::INT) OVER (PARTITION BY conv_id ORDER BY turn, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM u),
    j AS (SELECT a.note_id, b.note_id AS said_id, b.n + 1 - a.n - 1 AS back, {any_sql("b.text", X.TASK_SAID)} AND NOT regexp_matches(b.text, '{X.NO_TASK_SAID}') AS task FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.usable AND b.n + 1 <= a.n AND b.n + 1 > a.n - {X.LOOK_BACK} WHERE regexp_matches(a.text, '{X.REFERS}')),
    g AS (SELECT note_id, count(*) FILTER (WHERE task) AS tasks, max(said_id) FILTER (WHERE task) AS one, max(back) FILTER (WHERE task) AS back FROM j GROUP BY 1)
    SELECT n.note_id, CASE WHEN tasks = 1 THEN 'resolved' WHEN tasks IS NOT NULL THEN 'unresolved' ELSE 'not_applicable' END AS reference_status, CASE WHEN tasks = 1 THEN one ELSE -1 END AS antecedent_note_id, CASE WHEN tasks = 1 THEN back ELSE 0 END::INTEGER AS antecedent_offset FROM n LEFT JOIN g USING (note_id)""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """What each message refers to."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("ws", F.regexp_extract_all("body", F.lit(r"(\p{L}{3,12})"), F.lit(1)))
    said = F.element_at(F.array(*[F.lit(s) for s in REFERENCES]), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(REFERENCES) + 1).cast("int"))
    said = F.replace(F.replace(said, F.lit("{a}"), F.coalesce(F.get("ws", F.lit(0)), F.lit("abc"))), F.lit("{b}"), F.coalesce(F.get("ws", F.lit(1)), F.lit("abc")))
    found = X.antecedents(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("space"), F.col("turn").alias("at"), "role", F.concat(said, F.lit("。"), "body").alias("text")))
    return found.select("note_id", "reference_status", F.coalesce("antecedent_note_id", F.lit(-1)).alias("antecedent_note_id"), F.coalesce("antecedent_offset", F.lit(0)).cast("int").alias("antecedent_offset"))
