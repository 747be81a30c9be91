"""Driver queries for queues, lifecycles and operational metrics over orders and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scores import order_statistics
from brindle.functions.text import normalize_content
from brindle.operators import lifecycle as Y
from brindle.operators import metrics as M
from brindle.operators import relational as R
from brindle.plans.rules import norm_sql
from brindle.sources.tables import table
from brindle.streaming import control as C
from brindle.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _at(text: str):
    return F.to_timestamp(F.lit(text))


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


TASK_STATES = ("queued", "running", "retry", "blocked", "completed", "dead_letter", "cancelled")
_T = f"""t AS (SELECT event_id AS id, user_id AS space, {list(TASK_STATES)}[(event_id % 7)::INT + 1] AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS next_retry_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS lease_expires_at,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS started_at, (event_id % 4)::INTEGER AS attempt_count, (event_id % 6)::INTEGER AS claim_version, (event_id % 3)::INTEGER AS failure_count, 3 AS max_attempts, 0 AS defer_count, 'tok' || (event_id % 2) AS lease_token FROM events)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        i.alias("id"), F.col("user_id").alias("space"), _pick(TASK_STATES, i).alias("status"), F.when(i % 3 != 0, ts).alias("next_retry_at"), F.when(i % 5 != 0, ts + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"),
        F.when(i % 11 != 0, ts).alias("started_at"), (i % 4).cast("int").alias("attempt_count"), (i % 6).cast("int").alias("claim_version"), (i % 3).cast("int").alias("failure_count"), F.lit(3).alias("max_attempts"), F.lit(0).alias("defer_count"),
        F.concat(F.lit("tok"), (i % 2).cast("string")).alias("lease_token"), ts.alias("created_at"), F.col("value"),
    )


@query(f"""WITH {_T} SELECT id, claim_version + 1 AS claim_version, attempt_count + 1 AS attempt_count, coalesce(CASE WHEN status = 'running' THEN attempt_count END, -1) AS lost_attempt FROM t
    WHERE status NOT IN ('blocked', 'cancelled', 'completed', 'dead_letter') AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-15')
    AND (status <> 'running' OR coalesce(lease_expires_at <= TIMESTAMP '2024-01-15', started_at IS NULL OR floor(epoch(TIMESTAMP '2024-01-15')) - floor(epoch(started_at)) >= 600))""")
def task_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.task_claims(tasks(spark, d), _at("2024-01-15 00:00:00"), 600, "w").select("id", "claim_version", "attempt_count", F.coalesce("lost_attempt", F.lit(-1)).alias("lost_attempt"))


@query(f"""WITH {_T}, r AS (SELECT *, ['completed', 'failed', 'deferred'][(id % 3)::INT + 1] AS outcome, status = 'running' AND lease_token = 'tok1' AND lease_expires_at > TIMESTAMP '2024-01-15' AS own FROM t WHERE id % 2 = 1),
    o AS (SELECT *, coalesce(own, false) AS ok FROM r)
    SELECT id, CASE WHEN NOT ok THEN status WHEN outcome = 'failed' AND failure_count + 1 >= 3 THEN 'dead_letter' WHEN outcome = 'completed' THEN 'completed' ELSE 'retry' END AS status,
    failure_count + (ok AND outcome = 'failed')::INT AS failure_count, (ok AND outcome = 'deferred')::INT AS defer_count, ok AS accepted FROM o""")
def task_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the odd tasks, all with the token tok1."""
    rows = tasks(spark, d)
    reports = rows.where("id % 2 = 1").select("id", F.lit("tok1").alias("lease_token"), "claim_version", _pick(("completed", "failed", "deferred"), F.col("id")).alias("outcome"), F.lit(5.0).alias("delay"))
    return C.task_outcomes(rows, reports, _at("2024-01-15 00:00:00")).select("id", "status", "failure_count", "defer_count", "accepted")


@query(f"""WITH {_T} SELECT id, attempt_count + 1 AS attempt FROM t JOIN events e ON e.event_id = t.id WHERE status = 'retry' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20') ORDER BY next_retry_at ASC NULLS FIRST, e.ts, id LIMIT 50""")
def due_retries(spark: SparkSession, d: str) -> DataFrame:
    return C.due_retries(tasks(spark, d), _at("2024-01-20 00:00:00"), 50).select("id", "attempt")


STAGES = ("completed", "completed", "failed", "completed", "pending")
_I = f"""i AS (SELECT o_orderkey AS id, o_custkey AS space, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence_no, {list(STAGES)}[(o_orderkey // 3 % 5)::INT + 1] AS note_status, {list(STAGES)}[(o_orderkey // 7 % 5)::INT + 1] AS memory_status FROM orders),
    s AS (SELECT c_custkey AS space, c_custkey % 3 AS note_watermark, c_custkey % 2 AS memory_watermark FROM customer)"""
_MARK = "greatest({s}_watermark, coalesce(min(CASE WHEN sequence_no > {s}_watermark AND {s}_status NOT IN ('completed', 'failed') THEN sequence_no END) - 1, max(CASE WHEN sequence_no > {s}_watermark THEN sequence_no END), {s}_watermark))"


def inbox(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(R.Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("space"), place.alias("sequence_no"), _pick(STAGES, F.floor(k / 3)).alias("note_status"), _pick(STAGES, F.floor(k / 7)).alias("memory_status"))


def spaces(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("space"), (c % 3).alias("note_watermark"), (c % 2).alias("memory_watermark"))


@query(f"""WITH {_I}, g AS (SELECT space, note_watermark, memory_watermark, {_MARK.format(s="note")} AS n, {_MARK.format(s="memory")} AS m, min(CASE WHEN memory_status = 'failed' THEN sequence_no END) AS f FROM s LEFT JOIN i USING (space) GROUP BY 1, 2, 3)
    SELECT space, n AS note_watermark, m AS memory_watermark, coalesce(CASE WHEN f <= m THEN f END, 0) AS gap, m >= n AS readable FROM g""")
def space_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Both watermarks of every space; a failed message counts as closed and leaves a gap; whether reads need not wait."""
    found = C.space_progress(spaces(spark, d), inbox(spark, d))
    return found.select("space", "note_watermark", "memory_watermark", F.coalesce("gap", F.lit(0)).alias("gap"), (F.col("memory_watermark") >= F.col("note_watermark")).alias("readable"))


@query(f"""WITH {_I}, {_T}, a AS (SELECT id, space, sequence_no, CASE WHEN id % 4 = 0 THEN 'completed' ELSE note_status END AS note_status, CASE WHEN id % 8 = 0 THEN 'completed' ELSE memory_status END AS memory_status FROM i),
    p AS (SELECT space, {_MARK.format(s="note")} AS n, {_MARK.format(s="memory")} AS m FROM s JOIN a USING (space) WHERE space IN (SELECT space FROM i WHERE id % 4 = 0) GROUP BY space, note_watermark, memory_watermark),
    b AS (SELECT id, space, attempt_count, ['note', 'memory', 'weak'][(id % 3)::INT + 1] AS kind, id % 9 AS need FROM t WHERE status = 'blocked')
    SELECT id, 'event_' || md5(id || ':' || (attempt_count + 1)) AS event_id FROM b JOIN p USING (space) WHERE kind = 'weak' OR (kind = 'note' AND need <= n) OR (kind = 'memory' AND need <= m)""")
def completion_releases(spark: SparkSession, d: str) -> DataFrame:
    """The blocked tasks that are released when the notes of every fourth message, and the memories of every eighth, complete."""
    done = inbox(spark, d).where("id % 4 = 0").select(F.col("id").alias("inbox_id"), F.lit(True).alias("note"), (F.col("id") % 8 == 0).alias("memory"))
    rows = tasks(spark, d).select("id", "space", "status", "attempt_count", _pick(("note", "memory", "weak"), F.col("id")).alias("consistency"), (F.col("id") % 9).alias("required_watermark"))
    return C.completed_with_inbox(rows, done, inbox(spark, d), spaces(spark, d))[2].select("id", "event_id")


@query("""WITH i AS (SELECT conv_id * 100 + turn AS id, ['pending', 'blocked_sensitive', 'processed'][(turn % 3)::INT + 1] AS status, CASE WHEN conv_id % 4 = 0 THEN '/' || coalesce(text, '') ELSE coalesce(text, '') END AS body, ['pending', 'completed', 'failed'][(conv_id % 3)::INT + 1] AS note_status, conv_id * 100 + turn AS received_at FROM conversations),
    b AS (SELECT id, 'blocked_sensitive' AS reason FROM i WHERE status = 'blocked_sensitive' AND note_status NOT IN ('completed', 'failed') ORDER BY received_at LIMIT 40),
    c AS (SELECT id, 'skipped_command' AS reason FROM i WHERE status = 'pending' AND starts_with(body, '/') AND id % 2 = 0 ORDER BY received_at LIMIT 40) SELECT * FROM b UNION ALL SELECT * FROM c""")
def skipped_ingress(spark: SparkSession, d: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, d, "conversations").select((conv * 100 + turn).alias("id"), _pick(("pending", "blocked_sensitive", "processed"), turn).alias("status"), F.when(conv % 4 == 0, F.concat(F.lit("/"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), _pick(("pending", "completed", "failed"), conv).alias("note_status"))
    rows = rows.withColumns({"received_at": F.col("id"), "message_id": F.col("id")})
    waiting = rows.select("message_id", F.lit("ingest").alias("task_type"), F.when(F.col("id") % 2 == 0, "queued").otherwise("completed").alias("status"))
    return C.skipped_ingress(rows, waiting, 40)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events), w AS (SELECT user_id, min(sec) AS s FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.sec) FROM w JOIN e ON e.user_id = w.user_id AND e.sec >= w.s + 500000 GROUP BY 1),
    p AS (SELECT e.user_id, event_id, sec, max(s) AS s FROM e JOIN w ON w.user_id = e.user_id AND w.s <= sec GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY sec, event_id) AS n FROM p)
    SELECT event_id, n <= 2 AS admitted, CASE WHEN n <= 2 THEN 0 ELSE s + 500000 - sec END AS retry_after FROM r""")
def first_event_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Two events of a user in windows of 500 000 seconds that begin with their first event."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.first_event_limit(events, "user_id", "ts", "event_id", 500_000, 2)


@query()
def slot_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of two slots of a user that lapse after a day."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.slots(events, ["user_id"], "ts", "event_id", 86_400, 2)


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS dirty_since, floor(epoch(TIMESTAMP '2024-01-10')) - floor(epoch(min(ts))) >= 60 AS due FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def debounced_projections(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.debounced(changes, "user_id", "ts", 60, _at("2024-01-10 00:00:00")).select("user_id", F.date_format("dirty_since", "yyyy-MM-dd HH:mm:ss").alias("dirty_since"), "due")


@query("""WITH t AS (SELECT event_id AS id, ['queued', 'running', 'completed', 'failed'][(event_id % 4)::INT + 1] AS status, ts AS f FROM events), p AS (SELECT *, CASE WHEN status NOT IN ('queued', 'running') THEN row_number() OVER (PARTITION BY status IN ('queued', 'running') ORDER BY f DESC, id DESC) END AS n FROM t)
    SELECT id FROM p WHERE status IN ('queued', 'running') OR n <= 20 OR (status = 'failed' AND floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(f)) < 864000)""")
def registry_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), _pick(("queued", "running", "completed", "failed"), F.col("event_id")).alias("status"), F.col("ts").cast("timestamp").alias("finished_at"))
    return C.retained(rows, _at("2024-01-31 00:00:00"), 20, 864_000).select("id")


@query("""WITH s AS (SELECT c_custkey AS space, c_custkey % 1440 AS minute, c_custkey % 5 <> 0 AS enabled FROM customer), v AS (SELECT DISTINCT c_custkey AS space, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'sent' END AS status, c_custkey % 5 AS attempts FROM customer WHERE c_custkey % 2 = 0)
    SELECT space, '2024-01-31' AS day FROM s LEFT JOIN v USING (space) WHERE enabled AND minute <= 100 AND (status IS NULL OR (status = 'failed' AND attempts < 3))""")
def due_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    subscriptions = table(spark, d, "customer").select(c.alias("space"), (c % 1440).alias("minute_of_day"), (c % 5 != 0).alias("enabled"))
    sent = table(spark, d, "customer").where(c % 2 == 0).select(c.alias("space"), F.lit("2024-01-31").alias("day"), F.when(c % 3 == 0, "failed").otherwise("sent").alias("status"), (c % 5).alias("attempts"))
    return C.due_summaries(subscriptions, sent, _at("2024-01-31 01:40:00"))


_MS = "greatest(epoch_ms({b}) - epoch_ms({a}), 0)"
_PCT = lambda v: ", ".join(f"(SELECT v[(round_even((len(v) - 1) * {q}, 0))::BIGINT + 1]::DOUBLE FROM (SELECT list_sort(list({v})) AS v FROM m WHERE {v} IS NOT NULL)) AS p{int(q * 100)}_{v}" for q in (0.5, 0.95, 0.99))


@query(f"""WITH {_T}, x AS (SELECT t.*, e.ts AS created, CASE WHEN t.id % 4 = 0 THEN NULL ELSE e.ts + (t.id % 700) * INTERVAL 1 SECOND END AS started, CASE WHEN t.id % 6 = 0 THEN NULL ELSE e.ts + (t.id % 900) * INTERVAL 1 SECOND END AS ended FROM t JOIN events e ON e.event_id = t.id),
    m AS (SELECT *, {_MS.format(a="created", b="started")} AS queue_wait, {_MS.format(a="started", b="ended")} AS execution, {_MS.format(a="created", b="ended")} AS latency FROM x)
    SELECT {_PCT("queue_wait")}, {_PCT("execution")}, {_PCT("latency")}, (SELECT count(*) FROM m) AS task_count, (SELECT sum(failure_count)::BIGINT FROM m) AS failures, (SELECT count(*) FROM m WHERE status = 'dead_letter') AS dead""")
def operational_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Queue wait, execution and end-to-end latency of tasks, with counts."""
    i = F.col("id")
    later = lambda n: F.timestamp_micros(F.unix_micros("created_at") + (i % n) * 1_000_000)
    rows = tasks(spark, d).withColumns({"started": F.when(i % 4 != 0, later(700)), "ended": F.when(i % 6 != 0, later(900))})
    timed = M.durations(rows, {"queue_wait": ("created_at", "started"), "execution": ("started", "ended"), "latency": ("created_at", "ended")})
    counts = rows.agg(F.count(F.lit(1)).alias("task_count"), F.sum("failure_count").alias("failures"), F.count_if(F.col("status") == "dead_letter").alias("dead"))
    return M.percentile_columns(timed, ["queue_wait", "execution", "latency"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).crossJoin(counts)


@query("""WITH v AS (SELECT list_sort(list(w)) AS v FROM (SELECT (event_id % 400) AS w FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND event_id % 3 <> 0))
    SELECT v[(round_even((len(v) - 1) * 0.5, 0))::BIGINT + 1] AS p50, v[(round_even((len(v) - 1) * 0.95, 0))::BIGINT + 1] AS p95, v[(round_even((len(v) - 1) * 0.99, 0))::BIGINT + 1] AS p99 FROM v""")
def lock_waits(spark: SparkSession, d: str) -> DataFrame:
    """Lock waits of one action since a time; waits that are no whole numbers do not count."""
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("event_id") % 400).cast("string"))
    rows = table(spark, d, "events").where((F.col("event_type") == "click") & (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")))
    rows = rows.select(F.when(raw.rlike(r"^\d+$"), F.try_to_number(raw, F.lit("999999999"))).cast("long").alias("wait"), F.lit(1).alias("k"))
    return order_statistics(rows, ["k"], "wait", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest").select("p50", "p95", "p99")


@query("""WITH v AS (SELECT event_type AS statement, list_sort(list(round(value, 3))) AS v, count(*) AS n, count(*) FILTER (WHERE event_id % 50 = 0) AS failed, round(sum(value::DECIMAL(18, 6))::DOUBLE, 3) AS total FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT statement, n, failed, total, v[(round_even((n - 1) * 0.5, 0))::BIGINT + 1] AS p50, v[(round_even((n - 1) * 0.95, 0))::BIGINT + 1] AS p95, v[(round_even((n - 1) * 0.99, 0))::BIGINT + 1] AS p99 FROM v""")
def statement_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value IS NOT NULL").select(F.col("event_type").alias("statement"), (F.col("event_id") % 50 == 0).alias("bad"), "value")
    counts = rows.groupBy("statement").agg(F.count_if("bad").alias("failed"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 3).alias("total"))
    spread = order_statistics(rows.withColumn("ms", F.round("value", 3)), ["statement"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest")
    return spread.join(counts, "statement")


@query(f"""WITH {_T}, c AS (SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('blocked', 'queued', 'running', 'retry')) AS pending, count(*) FILTER (WHERE status IN ('cancelled', 'dead_letter')) AS bad, count(*) AS n FROM t),
    a AS (SELECT *, (SELECT count(*) FROM events WHERE event_id % 7 <> 6) AS accepted FROM c), u AS (SELECT *, greatest(0, 30 - least(30, greatest(0, accepted - (n - 200)))) AS unaccepted FROM a)
    SELECT n + 50 AS submitted, accepted, completed, pending, bad + unaccepted AS failed, 9 AS rate_limited, 11 AS duplicate, round((bad + unaccepted) / (n + 50)::DOUBLE, 6) AS failure_rate, n + 50 - (completed + bad + unaccepted + pending + 20) AS conservation_delta FROM u""")
def submission_report(spark: SparkSession, d: str) -> DataFrame:
    rows = tasks(spark, d)
    n = table(spark, d, "events").count()
    found = M.submission_report(rows, "status", rows.where("id % 7 <> 6"), {"submitted": n + 50, "accepted": n - 200, "duplicate": 11, "rate_limited": 9, "failed": 30})
    return found.select("submitted", "accepted", "completed", "pending", "failed", "rate_limited", "duplicate", "failure_rate", "conservation_delta")


@query("""WITH a AS (SELECT s_nationkey AS attempt, 1000 AS submitted, count(*) AS accepted, sum(s_suppkey % 3)::BIGINT AS duplicate, sum(s_suppkey % 2)::BIGINT AS rate_limited, sum(s_suppkey % 5)::BIGINT AS failed FROM supplier GROUP BY 1),
    r AS (SELECT 1000 AS submitted, arg_min(duplicate, attempt) AS d, arg_max(rate_limited, attempt) AS rl, arg_max(failed, attempt) AS f, sum(accepted)::BIGINT AS said, count(*) - 1 AS retry_attempts FROM a),
    x AS (SELECT *, greatest(d, submitted - 700 - rl - f) AS dup, least(700, said) AS acc FROM r)
    SELECT submitted::BIGINT AS submitted, acc AS accepted, dup AS duplicate, rl AS rate_limited, greatest(0, 700 - acc) + greatest(0, submitted - 700 - dup - rl) AS failed, retry_attempts FROM x""")
def retry_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    attempts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("attempt")).agg(F.lit(1000).cast("long").alias("submitted"), F.count(F.lit(1)).alias("accepted"), F.sum(k % 3).alias("duplicate"), F.sum(k % 2).alias("rate_limited"), F.sum(k % 5).alias("failed"))
    return M.retry_reconciliation(attempts, 700)


@query("SELECT source AS dataset, count(*) AS cases, round(avg(CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END), 6) AS recall, round(avg(doc_id % 5), 6) AS precision FROM documents GROUP BY 1")
def scores_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return M.by_dataset(table(spark, d, "documents").select(F.col("source").alias("dataset"), F.when(i % 3 > 0, i % 7).alias("recall"), (i % 5).alias("precision")), ["recall", "precision"])


_NOTE = "n AS (SELECT doc_id AS id, source, ['ready', 'provisional', 'enriching', 'failed'][(doc_id % 4)::INT + 1] AS enrichment_status, doc_id // 4 % 5 AS attempts, CASE WHEN doc_id % 9 = 0 THEN 'sensitive' ELSE 'normal' END AS sensitivity FROM documents)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), "source", "text", _pick(("ready", "provisional", "enriching", "failed"), i).alias("enrichment_status"), (F.floor(i / 4) % 5).alias("attempts"), F.when(i % 9 == 0, "sensitive").otherwise("normal").alias("sensitivity"))


@query(f"WITH {_NOTE} SELECT id FROM n WHERE enrichment_status IN ('provisional', 'enriching', 'failed') AND sensitivity = 'normal' ORDER BY id DESC LIMIT 200")
def provisional_notes(spark: SparkSession, d: str) -> DataFrame:
    return R.provisional(_notes(spark, d)).where("sensitivity = 'normal'").orderBy(F.desc("id")).limit(200).select("id")


@query(f"WITH {_NOTE} SELECT id, source FROM n WHERE enrichment_status IN ('provisional', 'enriching', 'failed') AND attempts < 3 AND sensitivity = 'normal' ORDER BY id LIMIT 100")
def pending_enrichments(spark: SparkSession, d: str) -> DataFrame:
    return R.pending_enrichments(_notes(spark, d), "id", 3, 100).select("id", "source")


@query(f"""WITH {_NOTE}, e AS (SELECT l_suppkey AS s, l_partkey AS t, min(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2), h AS (SELECT s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5),
    b AS (SELECT s AS id, t AS other, seen, 'out' AS way FROM e WHERE t IN (SELECT p_partkey FROM part) UNION ALL SELECT t, s, seen, 'in' FROM e) SELECT id, way, other FROM b WHERE id IN (SELECT id FROM h) QUALIFY row_number() OVER (PARTITION BY id, way ORDER BY seen, other) <= 3""")
def search_then_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of the five best hits."""
    hits = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.col("s_suppkey").alias("id"))
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.min("l_shipdate").alias("at"))
    return R.neighbours(hits, edges, table(spark, d, "part").select(F.col("p_partkey").alias("id")), 3).select("id", "way", "other")


@query("SELECT count(*) AS ready FROM embeddings JOIN documents ON vec_id = doc_id WHERE doc_id % 3 <> 0 AND label IS NOT NULL")
def ready_vectors(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    return R.ready_vectors(active, table(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("id")))


@query(f"WITH {_T} SELECT count(*) AS unpublished FROM orders JOIN t ON id = o_orderkey WHERE o_orderstatus <> 'F' AND o_orderkey % 4 <> 0")
def unpublished_events(spark: SparkSession, d: str) -> DataFrame:
    outbox = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.current_timestamp()).alias("published_at"), F.when(F.col("o_orderkey") % 4 == 0, "dead").otherwise("pending").alias("status"))
    return R.unpublished(outbox, tasks(spark, d).select("id"))


@query("""SELECT trace_id FROM (SELECT event_id AS trace_id, coalesce(CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 5 MINUTE END, ts) AS seen FROM events) ORDER BY seen DESC, trace_id DESC LIMIT 60""")
def newest_traces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("finished_at"))
    return Y.newest_traces(rows, 60).select("trace_id")


_D = "d AS (SELECT o_orderkey AS id, o_custkey AS candidate_id, o_orderdate AS created_at, ['applied', 'pending_review', 'rejected'][(o_orderkey % 3)::INT + 1] AS status FROM orders)"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("s").alias("space"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").alias("created_at"), _pick(("applied", "pending_review", "rejected"), F.col("o_orderkey")).alias("status"))


@query(f"WITH {_D} SELECT id, candidate_id FROM d WHERE status = 'pending_review' ORDER BY created_at DESC, id DESC LIMIT 50")
def decision_list(spark: SparkSession, d: str) -> DataFrame:
    return Y.decisions_of(_decisions(spark, d), status="pending_review").select("id", "candidate_id")


@query(f"WITH {_D} SELECT id, CASE WHEN row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) = 1 THEN candidate_id::VARCHAR ELSE candidate_id || ':legacy:' || id END AS candidate_key FROM d")
def decision_rekey(spark: SparkSession, d: str) -> DataFrame:
    return Y.rekeyed(_decisions(spark, d)).select("id", "candidate_key")


@query("""WITH e AS (SELECT l_orderkey AS id, l_linenumber AS n, ['pending', 'applied', 'failed'][(l_partkey % 3)::INT + 1] AS status, l_suppkey AS results, l_partkey AS target FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
    SELECT id, arg_min(target, n) AS target, arg_max(status, n) AS status, arg_max(results, n) AS results FROM e GROUP BY 1""")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines as entries of a decision: what was written first, with the last status and results."""
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), _pick(("pending", "applied", "failed"), F.col("l_partkey")).alias("status"), F.col("l_suppkey").alias("results"), F.lit(None).cast("string").alias("error"), F.col("l_partkey").alias("target"))
    first = R.Window.partitionBy("id", "at").orderBy("target", "results")
    entries = entries.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    return Y.decision_log(entries).select("id", "target", "status", "results")


@query("""WITH l AS (SELECT user_id AS candidate_id, event_id AS seen, ['extracted', 'processing', 'failed', 'applied'][(event_id % 4)::INT + 1] AS status FROM events),
    c AS (SELECT candidate_id, arg_max(status, seen) AS status, count(*) FILTER (WHERE status = 'processing') AS attempts, max(seen) AS u FROM l GROUP BY 1) SELECT candidate_id, status, attempts FROM c WHERE status IN ('extracted', 'validated', 'failed', 'processing') ORDER BY u, candidate_id LIMIT 100""")
def retryable_candidates(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("at"), _pick(("extracted", "processing", "failed", "applied"), F.col("event_id")).alias("status"), F.lit(None).cast("string").alias("error"))
    return Y.retryable_candidates(Y.candidate_states(log)).select("candidate_id", "status", "attempts")


@query(f"""WITH p AS (SELECT doc_id AS id, coalesce(text, '') AS content, ['new', 'merge', 'update_task', 'supersede', 'conflict'][(doc_id % 5)::INT + 1] AS rel, doc_id % 4 <> 3 AS ok, 'old' || doc_id % 3 AS target_content FROM documents),
    n AS (SELECT *, {norm_sql("target_content")} AS a, {norm_sql("content")} AS b FROM p),
    o AS (SELECT id, 2 AS version, CASE WHEN NOT ok OR rel IN ('merge', 'update_task') THEN 'archived' WHEN rel = 'conflict' THEN 'conflicted' ELSE 'active' END AS status, content, CASE WHEN NOT ok THEN 'user_rejected_pending_memory' WHEN rel IN ('merge', 'update_task') THEN rel || '_applied_after_review' ELSE 'user_approved_pending_memory' END AS reason FROM n),
    t AS (SELECT id + 1000000 AS id, 5 AS version, CASE WHEN rel IN ('merge', 'update_task') THEN 'active' WHEN rel = 'supersede' THEN 'superseded' ELSE 'conflicted' END AS status, CASE rel WHEN 'update_task' THEN content WHEN 'merge' THEN CASE WHEN a = '' OR contains(b, a) THEN content WHEN contains(a, b) THEN target_content
      ELSE regexp_replace(target_content, '[。；; ]+$', '') || '；' || regexp_replace(regexp_replace(content, '^[用户]+', ''), '[。；; ]+$', '') END ELSE target_content END AS content, 'user_approved_' || rel AS reason FROM n WHERE ok AND rel <> 'new')
    SELECT id, version, status, md5(content) AS content, reason FROM (SELECT * FROM o UNION ALL SELECT * FROM t)""")
def reviewed_memories(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of documents as pending memories, each against an older one."""
    i = F.col("doc_id")
    pending = table(spark, d, "documents").select(
        i.alias("id"), F.lit(1).alias("version"), F.coalesce("text", F.lit("")).alias("content"), F.lit("todo").alias("task_status"), F.lit(0.5).alias("confidence"), _pick(("new", "merge", "update_task", "supersede", "conflict"), i).alias("relation"), (i + 1_000_000).alias("target_id"), F.lit(4).alias("target_version"),
        F.lit("task").alias("target_type"), F.concat(F.lit("old"), (i % 3).cast("string")).alias("target_content"), F.lit("done").alias("target_task_status"),
    )
    verdicts = pending.select("id", F.when(F.col("id") % 4 != 3, "approve").otherwise("reject").alias("verdict"))
    found = Y.reviewed(pending.withColumn("target_id", F.when(F.col("relation") != "new", F.col("target_id"))), verdicts)
    return found.select("id", "version", "status", F.md5(F.col("content").cast("binary")).alias("content"), "reason")


_COR = ("完成报告", "重新开始写", "需要再改", "取消")


@query(f"""WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'semantic' ELSE 'task' END AS ty, CASE WHEN doc_id % 2 = 0 THEN 'todo' ELSE 'done' END AS st, {list(_COR)}[(doc_id % 4)::INT + 1] AS nc, ['done', CASE WHEN doc_id % 2 = 0 THEN 'todo' ELSE 'done' END, 'todo', 'done'][(doc_id % 4)::INT + 1] AS said FROM documents),
    e AS (SELECT *, CASE WHEN ty = 'task' THEN said END AS nx, CASE WHEN ty = 'task' AND st = 'done' AND said = 'todo' AND nc <> '重新开始写' THEN 'reopening_needs_wording' END AS error FROM c)
    SELECT id, CASE WHEN error IS NULL THEN 2 ELSE 1 END AS version, coalesce(CASE WHEN error IS NULL THEN nx ELSE st END, '') AS task_status, coalesce(error, '') AS error FROM e""")
def corrected_memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), F.lit(1).alias("version"), F.when(i % 3 == 0, "semantic").otherwise("task").alias("memory_type"), F.when(i % 2 == 0, "todo").otherwise("done").alias("task_status"), F.lit("x").alias("content"))
    changes = table(spark, d, "documents").select(i.alias("id"), _pick(_COR, i).alias("new_content"), F.lit(None).cast("string").alias("new_status"))
    return Y.corrected(rows, changes).select("id", "version", F.coalesce("task_status", F.lit("")).alias("task_status"), F.coalesce("error", F.lit("")).alias("error"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS space, o_orderkey % 3 AS ident, o_orderstatus = 'F' AS done FROM orders), t AS (SELECT min(id) AS tid, space, ident FROM m WHERE done GROUP BY 2, 3)
    SELECT id, tid AS other, 'superseded_by' AS relation FROM m JOIN t USING (space, ident) WHERE id <> tid AND NOT done UNION ALL SELECT tid, id, 'supersedes' FROM m JOIN t USING (space, ident) WHERE id <> tid AND NOT done""")
def archived_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Open tasks with the identity of one that is done: the relations that archive them."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("space"), (F.col("o_orderkey") % 3).alias("identity"), F.lit("task").alias("memory_type"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("active").alias("status"), F.lit(1).alias("current_version"))
    targets = rows.where("status = 'done'").groupBy("space", "identity").agg(F.min("id").alias("id"))
    return Y.archived_duplicates(targets, rows)[1].select(F.col("source_id").alias("id"), F.col("target").alias("other"), "relation")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def purged_relations(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"))
    return Y.purged(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey", "o_orderkey"]).select("o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS space, ['completed', 'failed', 'running'][(o_orderkey % 3)::INT + 1] AS status, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT space, arg_max(status, k) AS status, max(k) AS k FROM r GROUP BY 1)
    SELECT c_custkey AS space, '2024-W05' AS period FROM customer LEFT JOIN l ON l.space = c_custkey WHERE status IS NULL OR status = 'failed' OR (status = 'running' AND 100000 - k > 7200)""")
def due_consolidations(spark: SparkSession, d: str) -> DataFrame:
    """Weekly runs that may be reserved; a run is as old as its key is small."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("space"), F.lit("weekly").alias("cadence"), F.lit("2024-W05").alias("period"), _pick(("completed", "failed", "running"), k).alias("status"), F.timestamp_seconds(F.unix_seconds(_at("2024-01-31 00:00:00")) - 100_000 + k).alias("updated_at"))
    return Y.due_runs(table(spark, d, "customer").select(F.col("c_custkey").alias("space")), runs, "weekly", _at("2024-01-31 00:00:00"), 7200)


@query(f"WITH k AS (SELECT {norm_sql('lang')} AS g, CASE WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr' WHEN contains(lower(text), ' los ') THEN 'es' ELSE 'en' END AS p FROM documents), l AS (SELECT g AS label FROM k UNION SELECT p FROM k), b AS (SELECT label, count(*) FILTER (WHERE g = label AND p = label) AS tp, count(*) FILTER (WHERE g <> label AND p = label) AS fp, count(*) FILTER (WHERE g = label AND p <> label) AS fn FROM l, k GROUP BY 1), s AS (SELECT CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp)::DOUBLE, 6) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END AS rc FROM b) SELECT round(avg(CASE WHEN pr + rc = 0 THEN 0 ELSE round(2 * pr * rc / (pr + rc), 6) END), 6) AS macro_f1, count(*) AS labels FROM s")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    rows = table(spark, d, "documents").select(normalize_content(F.col("lang")).alias("lang"), F.when(has(" der "), "de").when(has(" les "), "fr").when(has(" los "), "es").otherwise("en").alias("guess"))
    return M.macro_f1(M.per_label_scores(rows, "lang", "guess"))
