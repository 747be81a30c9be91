"""Driver queries for hybrid search over memories, notes and candidates made of the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from brindle.functions import rules as R
from brindle.operators import hybrid as H
from brindle.operators import lists as L
from brindle.operators import task_status as S
from brindle.plans.relational import SENSITIVE_SQL
from brindle.plans.rules import any_sql, norm_sql, overlap_sql
from brindle.plans.search import cover_sql
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


ASOF = "2024-06-01 00:00:00"
KINDS, STATES = ("preference", "task", "semantic", "episodic"), ("active", "active", "conflicted", "forgotten")
#: Queries and the terms that they have by the rules of query terms.
ASKED = {1: ("that the whole", ["that", "the", "whole", "thatthewhole"]), 2: ("src3 license notice", ["src3", "license", "notice", "src3licensenotice"]), 3: ("key-17 what is der", ["key-17", "der", "what", "is", "key17whatisder"]), 4: ("the", ["the"])}

_M = f"""m AS (SELECT doc_id AS id, {list(KINDS)}[(doc_id % 4)::INT + 1] AS memory_type, coalesce(text, '') AS content, 'key-' || doc_id AS memory_key, source AS subject, lang AS predicate, NULL::VARCHAR AS object_value,
    {list(STATES)}[(doc_id // 4 % 4)::INT + 1] AS status, CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'todo' END AS task_status, (doc_id % 5) / 4::DOUBLE AS importance, (doc_id % 7) / 6::DOUBLE AS confidence, doc_id % 20 AS access_count,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 20 MINUTE AS updated_at FROM documents)"""


def memories(spark: SparkSession, d: str) -> DataFrame:
    """The documents as memories; all but the content follows from the id, source and language."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("id"), pick(KINDS, i).alias("memory_type"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("key-"), i.cast("string")).alias("memory_key"), F.col("source").alias("subject"), F.col("lang").alias("predicate"),
        F.lit(None).cast("string").alias("object_value"), pick(STATES, F.floor(i / 4)).alias("status"), F.when(i % 3 == 0, "done").otherwise("todo").alias("task_status"), (i % 5 / 4.0).alias("importance"), (i % 7 / 6.0).alias("confidence"),
        (i % 20).alias("access_count"), F.lit(None).cast("string").alias("polarity"), F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + i * 1200).alias("updated_at"),
        F.to_json(F.struct(F.concat(F.lit("fam-"), (i % 50).cast("string")).alias("task_family_key"))).alias("scope"),
    )


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, (q, _) in ASKED.items()], "query_id int, query string")


_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', {terms}, {words})" for i, (q, terms) in ASKED.items() for words in [sorted({w for t in terms for w in __import__("re").split(r"[^a-z0-9]+", t.lower()) if w})]) + ") v(query_id, query, terms, words))"
_LEX = "list_filter(regexp_split_to_array(lower(content || ' ' || coalesce(subject, '') || ' ' || coalesce(predicate, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_ANY = "len(list_filter(terms, lambda t: contains(lower({c}), lower(t)))) > 0"
_PAIRS = f"""{_M}, {_Q}, w AS (SELECT *, {_LEX} AS ws FROM m),
    p AS (SELECT query_id, query, w.*, words, {norm_sql("content")} = {norm_sql("query")} OR memory_key = trim(query) OR contains(lower(content), lower(trim(query)))
        OR (query_id = 3 AND (regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}])key-17([^\\p{{L}}\\p{{N}}]|$)') OR memory_key = 'key-17')) AS ex,
        ({_ANY.format(c="content")}) OR ({_ANY.format(c="coalesce(subject, '')")}) OR ({_ANY.format(c="coalesce(predicate, '')")}) AS lx, len(list_intersect(ws, words)) = len(words) AS ft FROM w, q),
    pw AS (SELECT query_id, id, updated_at, ws, words FROM p WHERE ft), {cover_sql("pw", "query_id, id")},
    l AS (SELECT query_id, id, 'exact' AS ch, 1.60::DOUBLE AS wt, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id DESC) AS rk, 30 AS n FROM p WHERE ex
      UNION ALL SELECT query_id, id, 'structured', 1.35, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id DESC), 120 FROM p WHERE lx
      UNION ALL SELECT query_id, id, 'fts', 1.00, row_number() OVER (PARTITION BY query_id ORDER BY cd DESC, updated_at DESC, id DESC), 120 FROM cover JOIN pw USING (query_id, id)),
    f AS (SELECT query_id, id, round(sum(wt / (60 + rk)), 6) AS rrf, count(DISTINCT ch)::INTEGER AS channels, min(CASE WHEN ch = 'exact' THEN rk END)::INTEGER AS exact_rank FROM l WHERE rk <= n GROUP BY 1, 2),
    h AS (SELECT f.* FROM f JOIN m USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, updated_at DESC, id DESC) <= 40)"""


@query(f"WITH {_PAIRS} SELECT query_id, id, rrf, channels, coalesce(exact_rank, 0) AS exact_rank FROM h")
def memory_channels(spark: SparkSession, d: str) -> DataFrame:
    """Exact, lexical and full-text lists of three queries, fused; forty best of each."""
    return H.memory_hits(_asked(spark), memories(spark, d)).select("query_id", "id", "rrf", "channels", F.coalesce("exact_rank", F.lit(0)).alias("exact_rank"))


_FIELDS = "SELECT query_id, query, id, unnest([content, subject, predicate, memory_key]) AS field FROM"
_AGE = f"greatest(0, (epoch_us(TIMESTAMP '{ASOF}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE)"
_RECENT = f"CASE WHEN {_AGE} <= 7 THEN 1.0 WHEN {_AGE} >= 365 THEN 0.1 ELSE greatest(0.1, 1 - {_AGE} / 365) END::DOUBLE"
_POLICY = f"""CASE WHEN topic <= 0 THEN 0 ELSE round((0.72::DOUBLE * topic + 0.08::DOUBLE * 0 + 0.07::DOUBLE * importance + 0.05::DOUBLE * {_RECENT} + 0.05::DOUBLE * confidence + 0.03::DOUBLE * least(access_count / 10.0::DOUBLE, 1.0))
    * CASE status WHEN 'active' THEN 1.0 WHEN 'conflicted' THEN 0.5 ELSE 0.2 END::DOUBLE, 4) END::DOUBLE"""


@query(f"""WITH {_PAIRS}, x AS (SELECT h.*, query, m.* EXCLUDE (id) FROM h JOIN m USING (id) JOIN q USING (query_id)), y AS ({_FIELDS} x), {overlap_sql("y", "query", "field")}, z AS (SELECT query_id, id, max(overlap) AS topic FROM ov GROUP BY 1, 2),
    b AS (SELECT x.*, 0.52::DOUBLE * {_POLICY} + 0.48::DOUBLE * least(1.0, rrf / max(rrf) OVER (PARTITION BY query_id) + 0.04::DOUBLE * greatest(0, channels - 1)) AS blend FROM x JOIN z USING (query_id, id)),
    g AS (SELECT *, round(least(1.0, CASE WHEN exact_rank IS NOT NULL THEN greatest(blend, 0.98::DOUBLE - 0.005::DOUBLE * greatest(0, exact_rank - 1)) ELSE blend END), 4)::DOUBLE AS final FROM b)
    SELECT query_id, id, final, row_number() OVER (PARTITION BY query_id ORDER BY exact_rank IS NOT NULL DESC, final DESC, rrf DESC, updated_at DESC, id DESC)::INTEGER AS rank FROM g WHERE final >= 0.45
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact_rank IS NOT NULL DESC, final DESC, rrf DESC, updated_at DESC, id DESC) <= 10""")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, policy re-rank and exact hits first, over active and other memories."""
    return H.search_memories(_asked(spark), memories(spark, d), F.to_timestamp(F.lit(ASOF)), 10)


#: Questions about tasks, with the terms that they have by the rules of query terms.
TASKS_ASKED = {
    11: ("license 任务进展如何", ["license", "进展", "任务进展如何", "任务进展", "务进展如", "进展如何", "任务进", "务进展", "进展如", "展如何", "任务", "务进"]),
    12: ("that the", ["that", "the", "thatthe"]), 13: ("任务怎么样了", ["任务怎么样了", "任务怎么", "务怎么样", "怎么样了", "任务怎", "务怎么", "怎么样", "么样了", "任务", "务怎", "怎么", "么样"]),
}
_TQ = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', {t}, ['zzzzz'])" for i, (q, t) in TASKS_ASKED.items()) + ") v(query_id, query, terms, words))"
# Both types hint at the task question by 任务, so all tasks are in its structured list; a question that expects a task lowers the score of events.
_HINTED = "    l AS (SELECT query_id, id, 'structured' AS ch, 1.35::DOUBLE AS wt, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id DESC) AS rk, 120 AS n FROM p WHERE memory_type = 'task' AND contains(query, '任务')\n      UNION ALL SELECT query_id, id, 'exact'"
_TASK_POLICY = _POLICY.replace("0.08::DOUBLE * 0", "0.08::DOUBLE * intent").replace("topic <= 0", "topic <= 0 AND intent <= 0").replace("WHEN 'active' THEN 1.0", "WHEN 'active' THEN fit")


def _hits_sql(kind: str, most: int) -> str:
    """The hits of the questions among memories of one type, scored and ranked: query_id, id, rank, final and what the memory is about."""
    pairs = _PAIRS.replace(_Q, _TQ).replace("    l AS (SELECT query_id, id, 'exact' AS ch, 1.60::DOUBLE AS wt,", _HINTED + ", 1.60,").replace("AS rk, 30 AS n FROM p WHERE ex", ", 30 FROM p WHERE ex").replace("DESC) <= 40)", f"DESC) <= {4 * most})")
    pairs = pairs.replace("INTERVAL 20 MINUTE AS updated_at FROM documents)", f"INTERVAL 20 MINUTE AS updated_at FROM documents WHERE doc_id % 4 = {KINDS.index(kind)})")
    return f"""(WITH {pairs}, x AS (SELECT h.*, query, m.* EXCLUDE (id) FROM h JOIN m USING (id) JOIN q USING (query_id)), y AS ({_FIELDS} x), {overlap_sql("y", "query", "field")}, z AS (SELECT query_id, id, max(overlap) AS topic FROM ov GROUP BY 1, 2),
    e AS (SELECT x.*, topic, {any_sql("query", R.ASKS_TASK)} OR ({any_sql("query", R.ASKS_STATUS)} AND NOT {any_sql("query", R.NOT_STATUS)}) AS asks FROM x JOIN z USING (query_id, id)),
    i AS (SELECT *, CASE WHEN asks AND memory_type = 'task' THEN 1 ELSE 0 END AS intent, CASE WHEN asks AND memory_type <> 'task' THEN 0.35 ELSE 1.0 END AS fit FROM e),
    b AS (SELECT *, 0.52::DOUBLE * {_TASK_POLICY} + 0.48::DOUBLE * least(1.0, rrf / max(rrf) OVER (PARTITION BY query_id) + 0.04::DOUBLE * greatest(0, channels - 1)) AS blend FROM i),
    g AS (SELECT *, round(least(1.0, CASE WHEN exact_rank IS NOT NULL THEN greatest(blend, 0.98::DOUBLE - 0.005::DOUBLE * greatest(0, exact_rank - 1)) ELSE blend END), 4)::DOUBLE AS final FROM b)
    SELECT query_id, id, final, {norm_sql("content || ' ' || coalesce(subject, '') || ' ' || coalesce(predicate, '') || ' ' || memory_key || ' fam-' || (id % 50) || CASE WHEN id % 3 = 0 THEN ' fam-' || (id % 100 // 2) ELSE '' END")} AS about,
      row_number() OVER (PARTITION BY query_id ORDER BY exact_rank IS NOT NULL DESC, final DESC, rrf DESC, updated_at DESC, id DESC) AS rank FROM g QUALIFY rank <= {most})"""


def _status_sql(limit: int) -> str:
    bare = norm_sql("part")
    for w in S.NOISE:
        bare = f"replace({bare}, '{w}', '')"
    return f"""WITH {_TQ}, w AS (SELECT query_id, unnest(regexp_split_to_array(query, '\\s+')) AS part, generate_subscripts(regexp_split_to_array(query, '\\s+'), 1) AS at_ FROM q), v AS (SELECT query_id, {bare} AS bare, min(at_) AS at_ FROM w GROUP BY 1, 2),
    a AS (SELECT query_id, coalesce(string_agg(bare, '' ORDER BY at_) FILTER (length(bare) >= 2), '') AS anchor FROM v GROUP BY 1),
    t AS (SELECT * FROM {_hits_sql("task", max(3 * limit, 12))} JOIN a USING (query_id) WHERE CASE WHEN anchor <> '' THEN contains(about, anchor) ELSE final >= 0.62 END),
    f AS (SELECT query_id, id % 50 AS fam FROM t UNION SELECT query_id, id % 100 // 2 FROM t WHERE id % 3 = 0),
    e AS (SELECT * FROM {_hits_sql("episodic", max(2 * limit, 8))} JOIN a USING (query_id) WHERE CASE WHEN anchor <> '' THEN contains(about, anchor) ELSE final >= 0.62 END OR (id % 3 = 0 AND (query_id, id % 100 // 2) IN (SELECT (query_id, fam) FROM f))),
    u AS (SELECT query_id, id, 'current_task' AS role, 0 AS part, rank FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {limit} UNION ALL SELECT query_id, id, 'historical_event', 1, rank FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 2)
    SELECT query_id, id, role, row_number() OVER (PARTITION BY query_id ORDER BY part, rank)::INTEGER AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, rank) <= {limit}"""


@query(_status_sql(6))
def task_status(spark: SparkSession, d: str) -> DataFrame:
    """The tasks that three questions name or mean, then the events of the same names or families."""
    i = F.col("id")
    scope = F.to_json(F.struct(F.concat(F.lit("fam-"), (i % 50).cast("string")).alias("task_family_key"), F.when(i % 3 == 0, F.concat(F.lit("fam-"), F.floor(i % 100 / 2).cast("string"))).alias("related_task_family_key")))
    asked = spark.createDataFrame([(n, q) for n, (q, _) in TASKS_ASKED.items()], "query_id int, query string")
    return S.task_status_search(asked, memories(spark, d).withColumn("scope", scope), F.to_timestamp(F.lit(ASOF)), 6)


@query(f"""WITH {_M}, {_Q}, x AS (SELECT query_id, query, n.* FROM (SELECT * FROM m ORDER BY updated_at DESC, id DESC LIMIT 100) n, q), y AS ({_FIELDS} x), {overlap_sql("y", "query", "field")}, z AS (SELECT query_id, id, max(overlap) AS topic FROM ov GROUP BY 1, 2),
    g AS (SELECT x.*, {_POLICY} AS score FROM x JOIN z USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, id DESC)::INTEGER AS rank FROM g WHERE score >= 0.05) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def memory_score_linear(spark: SparkSession, d: str) -> DataFrame:
    """The policy score alone over the hundred newest memories."""
    return H.score_linear(_asked(spark), memories(spark, d), F.to_timestamp(F.lit(ASOF)), 10, min_score=0.05)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("summary"), "text", F.when(F.col("toxic") == 1, "sensitive").otherwise("normal").alias("sensitivity"), F.col("doc_id").alias("created_at"))


_N = "n AS (SELECT doc_id AS id, text, concat_ws(' ', source, lang, text) AS doc FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) WHERE toxic IS DISTINCT FROM 1)"
_WORDS = "list_filter(regexp_split_to_array(lower(doc), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


_NOTE_TERMS = ["license", "key", "licensekey"]


@query(f"""WITH {_N}, w AS (SELECT *, {_WORDS} AS ws FROM n), t AS (SELECT *, contains(lower(doc), 'license key') AS ex, len(list_intersect(ws, {_NOTE_TERMS})) = 3 AS ft, len(list_filter({_NOTE_TERMS}, lambda x: contains(lower(doc), x))) > 0 AS lx FROM w),
    tw AS (SELECT id, ws, {_NOTE_TERMS} AS words FROM t WHERE ft), {cover_sql("tw", "id")},
    l AS (SELECT id, 1.55::DOUBLE AS wt, row_number() OVER (ORDER BY id DESC) AS rk FROM t WHERE ex UNION ALL SELECT id, 1.0, row_number() OVER (ORDER BY cd DESC, id DESC) FROM cover
      UNION ALL SELECT id, 0.85, row_number() OVER (ORDER BY id DESC) FROM t WHERE lx),
    f AS (SELECT id, round(sum(wt / (60 + rk)), 6) AS score FROM l WHERE rk <= 40 GROUP BY 1 ORDER BY score DESC, id DESC LIMIT 20)
    SELECT id, score FROM f JOIN n USING (id) WHERE NOT {SENSITIVE_SQL} ORDER BY score DESC, id DESC LIMIT 10""")
def note_search(spark: SparkSession, d: str) -> DataFrame:
    return H.search_notes("license key", _notes(spark, d), 10)


def _fallback_sql(match: str, parts: list[str]) -> str:
    return f"""WITH {_N}, w AS (SELECT *, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS ws FROM n), a AS (SELECT *, 'words' AS way FROM w WHERE {match} ORDER BY id DESC LIMIT 24),
    b AS (SELECT *, 'parts' AS way FROM w WHERE {" OR ".join(f"contains(lower(doc), '{p}')" for p in parts)} ORDER BY id DESC LIMIT 24), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) = 0)
    SELECT id, way FROM u WHERE NOT {SENSITIVE_SQL} ORDER BY id DESC LIMIT 8"""


@query(_fallback_sql("(contains(ws, ' that the ') AND NOT contains(ws, ' license ')) OR (contains(ws, ' der '))", ["x"]))
def note_fallback_words(spark: SparkSession, d: str) -> DataFrame:
    return H.notes_fallback('"that the" -license or der', _notes(spark, d), 8)


@query(_fallback_sql("contains(ws, ' zzzyx ') AND contains(ws, ' the ')", ["zzzyx the", "zzzyx", "the"]))
def note_fallback_parts(spark: SparkSession, d: str) -> DataFrame:
    return H.notes_fallback("zzzyx the", _notes(spark, d), 8)


@query(f"""WITH {_M}, k AS (SELECT *, 'fam-' || (id % 50) AS fam FROM m), c AS (SELECT id AS candidate_id, memory_type AS ct, 'key-' || (id + 4) AS ck, subject AS cs, predicate AS cp, fam AS cf FROM k WHERE id % 100 = 0),
    p AS (SELECT * FROM k JOIN c ON memory_type = ct),
    l AS (SELECT candidate_id, id, 'exact' AS ch, 1.60::DOUBLE AS wt, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC, id DESC) AS rk, 20 AS n FROM p WHERE memory_key = ck
      UNION ALL SELECT candidate_id, id, 'structured', 1.35, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN memory_key = ck THEN 0 ELSE 1 END, updated_at DESC, id DESC), 60 FROM p WHERE lower(predicate) = lower(cp)
      UNION ALL SELECT candidate_id, id, 'family', 1.20, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC, id DESC), 20 FROM p WHERE ct = 'task' AND fam = cf
      UNION ALL SELECT candidate_id, id, 'structured', 1.35, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC, id DESC), 60 FROM p WHERE ct = 'task'),
    f AS (SELECT candidate_id, id, round(sum(wt / (60 + rk)), 6) AS rrf, count(DISTINCT ch)::INTEGER AS channels FROM l WHERE rk <= n GROUP BY 1, 2),
    s AS (SELECT f.*, updated_at, round(rrf + CASE WHEN memory_key = ck THEN 0.08 ELSE 0 END + CASE WHEN {norm_sql("cs")} = {norm_sql("subject")} AND cs <> '' THEN 0.03 ELSE 0 END + CASE WHEN {norm_sql("cp")} = {norm_sql("predicate")} AND cp <> '' THEN 0.03 ELSE 0 END, 6)::DOUBLE AS score
          FROM f JOIN k USING (id) JOIN c USING (candidate_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, updated_at DESC, id DESC)::INTEGER AS rank FROM s) SELECT candidate_id, id, score, channels, rank FROM r WHERE rank <= 20""")
def adjudication_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Memories for each candidate (ids divisible by 100) by key, slots, family and recency."""
    rows = memories(spark, d)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("candidate_id"), "memory_type", F.concat(F.lit("key-"), (F.col("id") + 4).cast("string")).alias("memory_key"), "subject", "predicate", "object_value", F.lit(None).cast("array<string>").alias("entities"), "scope")
    return H.slot_channels(asked, rows, 20)


@query(f"""WITH {_M}, t AS (SELECT *, 'topic-' || (id % 300) AS topic, 1 + 1 + 1 + 1 AS complete FROM m WHERE status = 'active' AND memory_type = 'task' ORDER BY updated_at DESC, id DESC LIMIT 120),
    s AS (SELECT * FROM t WHERE task_status = 'todo'), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY updated_at DESC, id) = 1)
    SELECT id, topic, row_number() OVER (ORDER BY updated_at DESC, id)::INTEGER AS rank FROM b ORDER BY updated_at DESC, id LIMIT 30""")
def task_list(spark: SparkSession, d: str) -> DataFrame:
    """The open tasks, the best row of each topic, in business order."""
    items = memories(spark, d).withColumns({"canonical_topic": F.concat(F.lit("topic-"), (F.col("id") % 300).cast("string")), "content": F.lit("x")})
    return L.task_list(items, 30, "todo").select("id", F.col("canonical_topic").alias("topic"), "rank")


@query(f"""WITH {_M}, e AS (SELECT *, (TIMESTAMP '2024-03-01' + (id % 90) * INTERVAL 1 DAY)::TIMESTAMP AS event_time FROM m WHERE status = 'active' AND memory_type = 'episodic' ORDER BY updated_at DESC, id DESC LIMIT 40)
    SELECT id, row_number() OVER (ORDER BY CASE WHEN id % 5 = 0 THEN NULL ELSE event_time END DESC NULLS LAST, updated_at DESC, id)::INTEGER AS rank FROM e ORDER BY rank LIMIT 10""")
def recent_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes by their business time; those without an event time come after."""
    day = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-03-01 00:00:00"))) + (F.col("id") % 90) * 86400)
    items = memories(spark, d).withColumns({"event_time": F.when(F.col("id") % 5 != 0, day), "content": F.lit("x")})
    return L.recent_episodes(items, 10).select("id", "rank")


@query(f"""WITH {_M}, a AS (SELECT memory_type, id, round(0.7 * importance + 0.3 * confidence, 6) AS score, updated_at FROM m WHERE status = 'active')
    SELECT memory_type, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY score DESC, updated_at DESC, id DESC) AS rank FROM a) WHERE rank <= 5""")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    """The five best memories of each type by a given score."""
    hits = memories(spark, d).where("status = 'active'").withColumn("score", F.round(0.7 * F.col("importance") + 0.3 * F.col("confidence"), 6))
    return L.profile(hits, 5).select("memory_type", "id", "rank")


@query(f"""WITH {_M}, v AS (SELECT id, updated_at, 1 + id % 4 AS n FROM m), b AS (SELECT id, n FROM v ORDER BY n DESC, updated_at DESC LIMIT 1)
    SELECT id AS memory_id, unnest(range(1, n + 1)) AS version FROM b""")
def memory_history(spark: SparkSession, d: str) -> DataFrame:
    """The version rows of the timeline with most versions, overlap and score, then the latest update."""
    rows = memories(spark, d).select("id", "updated_at", F.lit(0.5).alias("overlap"), F.lit(0.5).alias("score"))
    versions = rows.select("id", F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 4)).alias("version"))
    return L.history(rows, versions).select(F.col("id").alias("memory_id"), "version")


@query()
def coverage_list(spark: SparkSession, d: str) -> DataFrame:
    """The hits of a listing question, spread over identities and types."""
    rows = memories(spark, d).orderBy(F.desc("updated_at"), F.desc("id")).limit(200)
    hits = rows.select(F.lit(1).alias("query_id"), F.lit("列出所有任务").alias("query"), "id", F.round(0.5 + 0.1 * F.col("importance"), 4).alias("score"), "memory_type", F.concat(F.lit("fam-"), (F.col("id") % 7).cast("string")).alias("identity"), (F.col("id") % 3 == 0).alias("stated"))
    return L.cover(hits, 12)
