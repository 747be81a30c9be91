"""Driver queries for adjudication and apply, over orders as candidates and customers as memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import adjudication as A
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


KINDS = ("task", "preference", "semantic", "episodic")
ACTIONS = ("add_source", "merge", "update", "update_task", "supersede", "conflict", "pending_review", "discard", "insert")


def _pick(values: tuple, at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _text(c) -> F.Column:
    return c.cast("string")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = _pick(KINDS, c)
    content = F.concat(F.lit("x"), _text(c), F.when((k % 7 == 0) & (c % 8 < 6), " 更正").otherwise(""), F.when(k % 5 == 0, " 详情").otherwise(""))
    return table(spark, d, "orders").select(
        F.concat(F.lit("c"), _text(k)).alias("candidate_id"), k.alias("note_id"), (c % 3).alias("space"), k.alias("at"), kind.alias("memory_type"), F.concat(kind, F.lit(":"), _text(c)).alias("memory_key"), content.alias("content"), F.lit("u").alias("subject"),
        F.when(kind == "episodic", "v").alias("object_value"), F.when(kind == "task", F.when(F.col("o_orderstatus") == "F", "done").otherwise("todo")).alias("task_status"), F.when(kind == "preference", _pick(("positive", "negative"), k)).alias("polarity"),
        F.lit(0.5).alias("importance"), (k % 10 / 10).alias("confidence"), (k % 13 != 0).alias("should_store"),
    )


def _memories(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = _pick(KINDS, c)
    return table(spark, d, "customer").where("c_custkey % 8 < 6").select(
        F.concat(F.lit("m"), _text(c)).alias("id"), (c % 3).alias("space"), kind.alias("memory_type"), F.concat(kind, F.lit(":"), _text(c)).alias("memory_key"), F.concat(F.lit("x"), _text(c)).alias("content"), F.lit("u").alias("subject"), F.when(kind == "episodic", "v").alias("object_value"),
        F.when(kind == "task", _pick(("todo", "done"), F.floor(c / 8))).alias("task_status"), F.when(kind == "preference", "positive").alias("polarity"), F.lit(0.4).alias("importance"), F.lit(0.6).alias("confidence"), F.lit(3).alias("current_version"), F.lit("active").alias("status"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"),
    )


_C = f"""c AS (SELECT 'c' || o_orderkey AS candidate_id, o_orderkey AS k, o_custkey AS ck, {list(KINDS)}[(o_custkey % 4)::INT + 1] AS kind, o_orderkey % 7 = 0 AS corr, o_orderkey % 5 = 0 AS detail, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS st,
    CASE WHEN o_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS sign, (o_orderkey % 10) / 10::DOUBLE AS conf, o_orderkey % 13 <> 0 AS keep FROM orders),
    m AS (SELECT c_custkey AS ck, 'm' || c_custkey AS id, CASE WHEN (c_custkey // 8) % 2 = 0 THEN 'todo' ELSE 'done' END AS mst FROM customer WHERE c_custkey % 8 < 6)"""


@query(f"""WITH {_C}, j AS (SELECT c.*, m.id, mst FROM c LEFT JOIN m USING (ck)), r AS (SELECT *, CASE WHEN NOT keep THEN 'new|discard|candidate_should_not_store' WHEN id IS NULL THEN 'new|insert|no_related_active_memory' WHEN kind = 'semantic' THEN 'same|add_source|same_semantic_fact'
    WHEN kind = 'task' THEN CASE WHEN st = mst AND detail THEN 'merge|merge|task_detail_merge' WHEN st = mst THEN 'same|add_source|same_task_identity_and_status' WHEN mst = 'done' THEN 'conflict|pending_review|terminal_task_reactivation_requires_evidence' ELSE 'update_task|update_task|valid_task_state_transition' END
    WHEN kind = 'preference' THEN CASE WHEN corr THEN 'supersede|update|explicit_preference_correction' WHEN sign = 'negative' THEN 'update|update|preference_polarity_update' WHEN detail THEN 'merge|update|preference_scope_or_detail_merge' ELSE 'same|add_source|same_preference_identity' END
    ELSE CASE WHEN corr THEN 'supersede|update|explicit_event_correction' WHEN detail THEN 'merge|update|episodic_detail_merge' ELSE 'same|add_source|same_episodic_event' END END AS x FROM j),
    p AS (SELECT *, split_part(x, '|', 1) AS relation, split_part(x, '|', 2) AS act, split_part(x, '|', 3) AS why FROM r),
    f AS (SELECT *, CASE WHEN act = 'discard' THEN conf WHEN id IS NULL THEN greatest(conf, 0.8) WHEN act = 'add_source' THEN greatest(conf, 0.92) WHEN act = 'merge' THEN greatest(conf, 0.8) ELSE 0.6 * conf + 0.4 END AS sure FROM p),
    w AS (SELECT *, act IN ('merge', 'update', 'update_task', 'supersede', 'conflict') AND round(sure, 9) < 0.75 AS weak FROM f)
    SELECT candidate_id, relation, CASE WHEN weak THEN 'pending_review' ELSE act END AS action, why || CASE WHEN weak THEN '; below_auto_mutation_threshold' ELSE '' END AS reason, round(sure, 6) AS confidence, CASE WHEN act NOT IN ('discard') THEN id END AS target_id FROM w""")
def adjudicated_orders(spark: SparkSession, d: str) -> DataFrame:
    """A decision for each order as a candidate, its identity being its customer's."""
    found = A.adjudicate(_candidates(spark, d), _memories(spark, d))
    return found.select("candidate_id", "relation", "action", "reason", F.round("confidence", 6).alias("confidence"), "target_id")


def _applied(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    told = _candidates(spark, d).withColumn("action", _pick(ACTIONS, F.col("note_id"))).withColumn("custkey", F.split("memory_key", ":")[1].cast("long"))
    fresh = F.col("action").isin("insert", "discard")
    known = F.col("custkey") % 8 < 6
    told = told.withColumn("action", F.when(known | fresh, F.col("action")).otherwise("insert"))
    candidates = told.withColumn("memory_key", F.when(F.col("action").isin("insert", "discard"), F.concat("memory_key", F.lit("n"))).otherwise(F.col("memory_key")))
    decisions = told.select("candidate_id", "action", F.lit("r").alias("relation"), F.lit("why").alias("reason"), F.when(~F.col("action").isin("insert", "discard"), F.concat(F.lit("m"), F.col("custkey").cast("string"))).alias("target_id"), F.when(F.col("note_id") % 11 == 0, 2).otherwise(3).alias("snapshot_version"), F.lit(0.9).alias("confidence"))
    sources = candidates.select(F.lit("m0").alias("memory_id"), "note_id", F.lit("supported_by").alias("relation")).limit(0)
    return A.apply_decisions(decisions, candidates, _memories(spark, d), sources, candidates.where("note_id % 17 = 0").select("candidate_id"))


_APPLIED = f"""WITH {_C}, a AS (SELECT c.*, m.id AS mid, mst, CASE WHEN m.id IS NULL AND {list(ACTIONS)}[(k % 9)::INT + 1] NOT IN ('insert', 'discard') THEN 'insert' ELSE {list(ACTIONS)}[(k % 9)::INT + 1] END AS act FROM c LEFT JOIN m USING (ck) WHERE k % 17 <> 0),
    t AS (SELECT *, CASE WHEN act NOT IN ('insert', 'discard') THEN mid END AS target, k % 11 <> 0 AS current, act IN ('merge', 'update', 'update_task', 'supersede', 'conflict') AS changing FROM a),
    fs AS (SELECT target, min(k) AS fk, arg_min(CASE WHEN act = 'update_task' AND kind = 'task' THEN st WHEN act = 'update_task' THEN NULL ELSE CASE WHEN kind = 'task' THEN mst END END, k) AS fst FROM t WHERE changing AND current AND target IS NOT NULL GROUP BY 1),
    ins AS (SELECT ck, min(k) AS ik, arg_min(st, k) AS ist FROM t WHERE act = 'insert' GROUP BY 1),
    o AS (SELECT t.*, fk, ik, coalesce(target IS NOT NULL AND (coalesce(k > fk, false) OR NOT current), false) AS late, act = 'insert' AND k > ik AS twin, CASE WHEN coalesce(k > fk, false) THEN fst ELSE CASE WHEN kind = 'task' THEN mst END END AS held, ist FROM t LEFT JOIN fs USING (target) LEFT JOIN ins USING (ck)),
    g AS (SELECT *, CASE WHEN kind = 'task' THEN st IS NOT DISTINCT FROM (CASE WHEN twin THEN ist ELSE held END) ELSE kind = 'episodic' END AS agrees FROM o),
    z AS (SELECT *, CASE WHEN (late OR twin) AND agrees THEN 'add_source' WHEN late OR twin THEN 'pending_review' ELSE act END AS final FROM g)"""


@query(f"{_APPLIED} SELECT candidate_id, final AS action, CASE WHEN (late OR twin) AND agrees THEN 'concurrent_same_update_adds_source' WHEN late OR twin THEN 'stale_target_snapshot_requires_readjudication' ELSE 'why' END AS reason, CASE WHEN final = 'pending_review' THEN 'pending_review' ELSE 'applied' END AS status FROM z")
def applied_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What became of decisions made on one snapshot."""
    return _applied(spark, d)["decisions"].select("candidate_id", "action", "reason", "status")


@query(f"""{_APPLIED}, v AS (SELECT 'mem_' || substr(sha256((ck % 3) || '|' || candidate_id), 1, 16) AS memory_id, 1 AS version, CASE final WHEN 'pending_review' THEN 'pending_review' WHEN 'conflict' THEN 'conflicted' ELSE 'active' END AS status FROM z WHERE final IN ('insert', 'pending_review', 'supersede', 'conflict')
    UNION ALL SELECT target, 4, CASE final WHEN 'supersede' THEN 'superseded' WHEN 'conflict' THEN 'conflicted' ELSE 'active' END FROM z WHERE final IN ('merge', 'update', 'update_task', 'supersede', 'conflict')) SELECT memory_id, version::INTEGER AS version, status FROM v""")
def applied_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions that those decisions write."""
    return _applied(spark, d)["versions"].select("memory_id", "version", "status")
