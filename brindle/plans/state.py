"""Driver queries for versioned evolution, access control, decisions and queue control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import evolution as E
from brindle.operators import relational as R
from brindle.operators import retrieval as S
from brindle.sources.tables import table
from brindle.streaming import control as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ASOF = "2024-01-31 00:00:00"


def _asof():
    return F.to_timestamp(F.lit(ASOF))




@query("""WITH p AS (SELECT o_orderkey, ['task', 'semantic', 'preference', 'episodic'][(o_orderkey % 4)::INT + 1] AS mt, o_orderkey % 7 <> 0 AS same_type, o_custkey % 2 = 0 AS same_key, o_orderkey % 11 = 0 AS stale,
    o_custkey % 3 <> 0 AS instance, o_custkey % 13 = 0 AS changed, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS os, CASE WHEN o_custkey % 5 = 0 THEN 'done' ELSE 'todo' END AS ns,
    o_orderkey % 17 = 0 AS closure, o_orderkey % 19 = 0 AS meta, o_orderkey % 3 = 0 AS detail, o_orderkey % 23 = 0 AS terminal, o_custkey % 7 <> 0 AS scope, o_orderkey % 9 = 0 AS unconf, o_orderkey % 10 = 0 AS corr,
    CASE WHEN o_custkey % 4 = 1 THEN 'negative' ELSE 'positive' END AS op, CASE WHEN o_custkey % 9 = 1 THEN 'negative' ELSE 'positive' END AS np FROM orders),
    r AS (SELECT o_orderkey, CASE WHEN NOT same_type THEN 'new|insert|memory_type_mismatch|false' WHEN same_key AND stale THEN 'conflict|pending_review|candidate_observed_before_current_memory|false'
    WHEN mt = 'task' THEN CASE WHEN NOT instance THEN 'new|insert|task_requires_exact_canonical_key|false' WHEN changed THEN 'update_task|update_task|task_explicit_value_update|true'
      WHEN os = ns AND ns = 'done' AND closure THEN 'conflict|pending_review|task_closure_reason_conflict|false' WHEN os = ns AND meta THEN 'update_task|update_task|task_lifecycle_metadata_update|true'
      WHEN os = ns AND detail THEN 'merge|merge|task_detail_merge|true' WHEN os = ns THEN 'same|add_source|same_task_identity_and_status|true'
      WHEN terminal THEN 'conflict|pending_review|terminal_task_reactivation_requires_evidence|false' ELSE 'update_task|update_task|valid_task_state_transition|true' END
    WHEN mt = 'semantic' THEN CASE WHEN same_key THEN 'same|add_source|same_semantic_fact|true' ELSE 'new|insert|semantic_append_only|true' END
    WHEN mt = 'preference' THEN CASE WHEN NOT same_key OR NOT scope THEN 'new|insert|preference_identity_mismatch|false' WHEN unconf THEN 'conflict|pending_review|unconfirmed_preference_change|false'
      WHEN corr THEN 'supersede|update|explicit_preference_correction|true' WHEN op <> np THEN 'update|update|preference_polarity_update|true' WHEN detail THEN 'merge|update|preference_scope_or_detail_merge|true'
      ELSE 'same|add_source|same_preference_identity|true' END
    ELSE CASE WHEN NOT same_key AND corr AND scope THEN 'supersede|update|explicit_event_correction_across_topic|true' WHEN same_key AND (unconf OR (meta AND NOT corr)) THEN 'conflict|pending_review|unconfirmed_or_negative_event_claim|false'
      WHEN same_key AND corr THEN 'supersede|update|explicit_event_correction|true' WHEN same_key AND instance AND changed THEN 'update|update|episodic_time_or_fact_update|true'
      WHEN same_key AND instance AND detail THEN 'merge|update|episodic_detail_merge|true' WHEN same_key AND instance THEN 'same|add_source|same_episodic_event|true' ELSE 'new|insert|episodic_requires_exact_duplicate|false' END END AS x FROM p)
    SELECT o_orderkey, split_part(x, '|', 1) AS relation, split_part(x, '|', 2) AS action, split_part(x, '|', 3) AS reason, split_part(x, '|', 4) = 'true' AS approved FROM r""")
def relation_guard_table(spark: SparkSession, d: str) -> DataFrame:
    """The relation guard over pairs generated from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(x) for x in ("task", "semantic", "preference", "episodic")])
    pair = {
        "same_type": k % 7 != 0, "memory_type": F.element_at(kinds, (k % 4 + 1).cast("int")), "same_key": c % 2 == 0, "stale": k % 11 == 0, "instance": c % 3 != 0, "values_changed": c % 13 == 0,
        "old_status": F.when(F.col("o_orderstatus") == "F", "done").otherwise("todo"), "new_status": F.when(c % 5 == 0, "done").otherwise("todo"), "closure_differs": k % 17 == 0, "metadata_changed": k % 19 == 0,
        "detail": k % 3 == 0, "terminal_reactivation": k % 23 == 0, "same_scope": c % 7 != 0, "unconfirmed": k % 9 == 0, "correction": k % 10 == 0, "old_polarity": F.when(c % 4 == 1, "negative").otherwise("positive"),
        "new_polarity": F.when(c % 9 == 1, "negative").otherwise("positive"), "same_subject": F.lit(True), "same_predicate": c % 7 != 0, "same_value": c % 3 != 0, "time_change": c % 13 == 0, "negative_claim": k % 19 == 0,
    }
    return table(spark, d, "orders").select("o_orderkey", E.relation(pair).alias("r")).select("o_orderkey", *[F.col(f"r.{x}").alias(x) for x in E.RELATION_COLUMNS])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN true ELSE o_orderdate < (SELECT TIMESTAMP '1996-01-01') END AS stale FROM orders""")
def stale_evidence(spark: SparkSession, d: str) -> DataFrame:
    observed = F.when(F.col("o_orderkey") % 10 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", E.is_stale(observed, F.lit("1996-01-01T00:00:00")).alias("stale"))


@query("SELECT o_orderkey AS memory_id, 2 AS version, 'expired' AS status, strftime(o_orderdate, '%Y-%m-%d') AS valid_until FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-06-01'")
def expiry_versions(spark: SparkSession, d: str) -> DataFrame:
    active = F.when(F.col("o_orderstatus") == "O", "active").otherwise("archived")
    memories = table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), active.alias("status"), F.col("o_orderdate").alias("valid_until"), F.lit(1).alias("current_version"))
    return R.expired_versions(memories, F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'")).withColumn("valid_until", F.date_format("valid_until", "yyyy-MM-dd"))


@query("""WITH m AS (SELECT c_custkey AS key, 3 AS cv FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT o_custkey AS key, o_orderkey AS cid, o_orderdate AS seen FROM orders WHERE o_orderkey % 5 <> 0),
    j AS (SELECT c.key, cid, cv, row_number() OVER (PARTITION BY c.key ORDER BY seen, cid) AS rn FROM c LEFT JOIN m ON m.key = c.key)
    SELECT key, cid AS candidate_id, CASE WHEN cv IS NULL AND rn = 1 THEN 'insert' ELSE 'add_source' END AS action, coalesce(cv, 1) AS version FROM j""")
def idempotent_apply(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit(3).alias("current_version"))
    candidates = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("at"))
    return E.apply_candidates(memories, candidates, candidates.where("candidate_id % 5 = 0").select("candidate_id"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version, strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS valid_to FROM orders""")
def version_sequence(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return E.versions(changes, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


@query("""WITH h AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS status FROM orders), s AS (SELECT l_orderkey AS version, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT c_custkey AS id, h.version, h.status, coalesce(n, 0) AS n_sources FROM customer JOIN h ON h.id = c_custkey LEFT JOIN s ON s.version = h.version""")
def timeline_flat(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    sources = table(spark, d, "lineitem").join(history.drop("status"), F.col("l_orderkey") == F.col("version")).select("id", "version")
    return E.timeline(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), history, sources, "id")


@query("SELECT user_id, event_type, count(*) AS n_facts, max(event_id) AS updated, max(event_id) AS latest FROM events GROUP BY 1, 2")
def projection_rollup(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").withColumn("content", F.col("event_id"))
    return E.projection(facts, ["user_id", "event_type"], "event_id", "content")


@query("SELECT c_custkey, 5 + coalesce(n, 0) AS access_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def access_count_merge(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "customer").select("c_custkey", F.lit(5).alias("access_count"))
    return E.merge_counts(memories, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "access_count")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents v WHERE v.doc_id % 3 = 0 AND v.doc_id = d.doc_id AND sha256('m|' || v.text) = sha256('m|' || d.text))")
def vector_backfill(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.sha2(F.concat_ws("|", F.lit("m"), "text").cast("binary"), 256)
    docs = table(spark, d, "documents").select("doc_id", hashed.alias("content_hash"))
    return E.due_for_backfill(docs, docs.where("doc_id % 3 = 0"), "doc_id", "content_hash").select("doc_id")


@query("""WITH s AS (SELECT event_id, ['pending', 'processing', 'completed', 'failed', 'partial'][(event_id % 5)::INT + 1] AS status, event_id % 4 AS attempts, ts AS updated FROM events)
    SELECT event_id FROM s WHERE (status IN ('pending', 'failed', 'partial') AND attempts < 3) OR (status = 'processing' AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(updated) > 86400000000)""")
def extraction_retryable(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pending", "processing", "completed", "failed", "partial")])
    states = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"), (F.col("event_id") % 4).alias("attempts"), F.col("ts").cast("timestamp").alias("updated"))
    return E.retryable(states, _asof(), 86_400, 3).select("event_id")


@query("""WITH r AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS period FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS period FROM orders
    WHERE (o_custkey, strftime(o_orderdate, '%Y-%m')) NOT IN (SELECT (o_custkey, period) FROM r)""")
def consolidation_reservation(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), "o_orderstatus")
    return runs.select("o_custkey", "period").distinct().join(runs.where("o_orderstatus = 'F'").select("o_custkey", "period"), ["o_custkey", "period"], "left_anti")


@query("""WITH a AS (SELECT doc_id, ['normal', 'secret', 'sensitive'][(doc_id % 3)::INT + 1] AS sens, ['owner', 'restricted', 'public', ''][(doc_id % 4)::INT + 1] AS scope, source AS owner FROM documents)
    SELECT doc_id FROM a WHERE sens = 'normal' AND scope <> 'restricted' AND (scope NOT IN ('owner', '') OR owner = 'src1')""")
def acl_filter(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    ok = R.allowed(pick(("normal", "secret", "sensitive"), 3), pick(("owner", "restricted", "public", ""), 4), F.col("source"), F.lit("src1"), F.lit(False), F.lit(False))
    return table(spark, d, "documents").where(ok).select("doc_id")


@query("""WITH h AS (SELECT conv_id AS q, turn % 2 = 0 AS ok, turn % 3 <> 1 AS act, turn = 6 AS pend, CASE WHEN turn % 5 = 4 THEN 'negative' ELSE 'positive' END AS pol, role AS ident, CASE WHEN role = 'user' THEN 'todo' END AS ts, conv_id % 10 / 10.0::DOUBLE AS score FROM conversations),
    g AS (SELECT q, count(*) AS n, count(*) FILTER (WHERE ok) AS na, count(*) FILTER (WHERE ok AND act) AS nact, count(*) FILTER (WHERE ok AND pend) AS np, count(DISTINCT CASE WHEN ok THEN pol END) AS pols, count(DISTINCT CASE WHEN ok THEN ident END) AS ids,
      count(*) FILTER (WHERE ok AND ts IS NOT NULL) AS tasks, max(CASE WHEN ok THEN score END) AS top FROM h GROUP BY 1)
    SELECT q AS query_id, n, na AS n_allowed, CASE WHEN n > 0 AND na = 0 THEN 'restricted' WHEN na = 0 THEN 'no_answer' WHEN nact = 0 THEN 'history' WHEN np > 0 OR pols > 1 THEN 'conflict' WHEN ids >= 2 AND tasks >= 2 THEN 'clarification' WHEN top < 0.58 THEN 'qualified' ELSE 'answered' END AS answer_type FROM g""")
def answer_decision(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    hits = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), (turn % 2 == 0).alias("allowed"), (turn % 3 != 1).alias("active"), (turn == 6).alias("pending"), F.when(turn % 5 == 4, "negative").otherwise("positive").alias("polarity"),
        F.col("role").alias("identity"), F.when(F.col("role") == "user", "todo").alias("task_status"), (F.col("conv_id") % 10 / 10.0).alias("score"),
    )
    return S.answer_decision(hits)


_STATES = "['pending', 'published', 'failed', 'dead']"


@query(f"""WITH e AS (SELECT event_id, {_STATES}[(event_id % 4)::INT + 1] AS status, (event_id % 5)::INTEGER AS attempts, ts AS available, event_type <> 'error' AS ok FROM events),
    s AS (SELECT *, status NOT IN ('published', 'dead') AND available <= TIMESTAMP '2024-01-20' AS due FROM e)
    SELECT event_id, CASE WHEN due THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN NOT due THEN status WHEN ok THEN 'published' WHEN attempts + 1 >= 4 THEN 'dead' ELSE 'pending' END AS status,
    coalesce(CASE WHEN due AND NOT ok AND attempts + 1 < 4 THEN least(300, pow(2, attempts))::INTEGER END, 0) AS wait_seconds FROM s""")
def outbox_transition(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pending", "published", "failed", "dead")])
    events = table(spark, d, "events").select("event_id", "event_type", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("available_at"))
    stepped = C.outbox_step(events, F.to_timestamp(F.lit("2024-01-20 00:00:00")), F.col("event_type") != "error", 4)
    return stepped.withColumn("wait_seconds", F.coalesce("wait_seconds", F.lit(0)))


@query("""WITH e AS (SELECT event_id, ['pending', 'sending', 'failed', 'sent', 'unknown'][(event_id % 5)::INT + 1] AS status, event_id % 4 AS attempts, ts FROM events)
    SELECT event_id, (status IN ('pending', 'failed') OR (status = 'sending' AND floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts)) > 3600)) AND attempts < 3 AS reserved FROM e""")
def delivery_reservation(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pending", "sending", "failed", "sent", "unknown")])
    rows = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"), (F.col("event_id") % 4).alias("attempts"), F.col("ts").cast("timestamp").alias("updated"))
    return C.delivery_step(rows, _asof(), 3600, 3).select("event_id", "reserved")


@query("""WITH t AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 2 = 0 THEN 'blocked' ELSE 'done' END AS status, event_id // 2 AS parent FROM events)
    SELECT a.id, a.parent AS parent_id FROM t a JOIN t b ON a.parent = b.id WHERE a.status = 'blocked' AND b.status = 'failed'""")
def cascade_cancel(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 2 == 0, "blocked").otherwise("done")
    return C.cancelled(table(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.floor(F.col("event_id") / 2).alias("parent_id")))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 2 AS admitted,
    ((floor(epoch(ts) / 86400) + 1) * 86400 - floor(epoch(ts)))::BIGINT AS retry_after FROM events""")
def aligned_window_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.aligned_limit(events, ["user_id"], "ts", 86_400, 2, ["ts", "event_id"]).select("event_id", "admitted", "retry_after")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS copy FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS sequence_no FROM f WHERE copy = 1""")
def ingress_sequence(spark: SparkSession, d: str) -> DataFrame:
    return C.ingest_once(table(spark, d, "events"), ["user_id", "event_type", "ts"], "user_id", ["event_id"]).select("event_id", "sequence_no")
