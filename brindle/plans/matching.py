"""Driver queries for matching, evidence, audits and sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import matching as X
from brindle.operators.alignment import aligned
from brindle.plans.memory import KINDS, STATES, memories
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


@query(f"""WITH m AS (SELECT doc_id AS id, {list(KINDS)}[(doc_id % 4)::INT + 1] AS ty, doc_id % 40 AS k, {list(STATES)}[(doc_id // 4 % 4)::INT + 1] AS st, CASE WHEN doc_id % 3 = 0 THEN 'v3' ELSE 'v2' END AS ver, 1 + doc_id % 3 AS src, ['fact', 'city', ''][(doc_id % 3)::INT + 1] AS pred FROM documents),
    d AS (SELECT ty, k FROM m WHERE st = 'active' GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE ver = 'v3') > 0),
    f AS (SELECT id, 'generic_semantic_fact_multiple_sources' AS reason FROM m WHERE ty = 'semantic' AND pred IN ('fact', '') AND src > 1 UNION SELECT id, 'legacy_task_key_multiple_sources' FROM m WHERE ty = 'task' AND ver <> 'v3' AND src > 1
      UNION SELECT id, 'duplicate_active_canonical_key' FROM m JOIN d USING (ty, k) WHERE st = 'active') SELECT reason, count(*) AS n FROM f GROUP BY 1""")
def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = memories(spark, d).withColumns({
        "memory_key": (i % 40).cast("string"), "key_version": F.when(i % 3 == 0, "v3").otherwise("v2"), "n_sources": 1 + i % 3, "predicate": F.element_at(F.array(F.lit("fact"), F.lit("city"), F.lit("")), (i % 3 + 1).cast("int")),
    })
    return X.audit_counts(X.merge_audit(rows, "v3"))


@query("""WITH l AS (SELECT user_id, count(*) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, coalesce(last, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_no FROM events LEFT JOIN l USING (user_id) WHERE event_type = 'click'""")
def next_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as new messages, numbered on from the purchases of their user."""
    events = table(spark, d, "events")
    log = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("sequence_no"))
    return X.next_sequences(events.where("event_type = 'click'"), log, "user_id", ["ts", "event_id"]).select("event_id", "sequence_no")


@query("""SELECT o_custkey, coalesce(min(o_orderkey) FILTER (WHERE o_orderkey > o_custkey AND o_orderstatus = 'P'), 0) AS first_open, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey > o_custkey), 0) AS last FROM orders GROUP BY 1""")
def watermark_probe(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    marks = orders.select("o_custkey").distinct().withColumn("watermark", F.col("o_custkey"))
    found = X.watermark_probe(orders, marks, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P")
    return found.select("o_custkey", F.coalesce("first_open", F.lit(0)).alias("first_open"), F.coalesce("last", F.lit(0)).alias("last"))


@query("""WITH q AS (SELECT item_id, coalesce(text, '') AS q FROM benchmark WHERE item_id % 10 = 0), h AS (SELECT item_id, q, doc_id, coalesce(text, '') AS c, source, lang, round(((doc_id * 7 + item_id) % 100) / 100.0::DOUBLE, 2) AS score FROM q JOIN documents ON doc_id % 50 = item_id % 50),
    t AS (SELECT *, list_distinct(regexp_extract_all(replace(lower(q), 'ß', 'ss'), '[a-z0-9][a-z0-9+#._-]*')) AS a, list_distinct(regexp_extract_all(replace(lower(c || ' ' || source || ' ' || lang || ' semantic'), 'ß', 'ss'), '[a-z0-9][a-z0-9+#._-]*')) AS b, max(score) OVER (PARTITION BY item_id) AS top FROM h),
    o AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END AS overlap FROM t)
    SELECT item_id AS query_id, doc_id AS id, round(overlap, 6) AS overlap FROM o WHERE score >= 0.7 OR (top >= 0.9 AND score >= greatest(0.45, top - 0.25)) OR (score >= 0.45 AND overlap >= 0.2)
      OR (score >= 0.45 AND contains(lower(q), 'focus') AND contains(c, 'focus'))""")
def relevant_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Given scores of documents for benchmark items as questions."""
    asked = table(spark, d, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("subject"), F.col("lang").alias("predicate"))
    hits = docs.join(asked, F.col("id") % 50 == F.col("query_id") % 50).withColumn("score", F.round((F.col("id") * 7 + F.col("query_id")) % 100 / 100.0, 2))
    hits = hits.withColumns({"object_value": F.lit(None).cast("string"), "memory_key": F.lit(None).cast("string"), "task_status": F.lit(None).cast("string"), "memory_type": F.lit("semantic")})
    return X.relevant_evidence(hits).select("query_id", "id", F.round("overlap", 6).alias("overlap"))


_ALIGN = """WITH RECURSIVE i AS (SELECT conv_id, turn, coalesce(substr(text, 1, 2), '') AS span, coalesce(role, '') AS topic, coalesce(substr(text, length(text) - 1), '') AS key FROM conversations),
    p AS (SELECT conv_id, list(struct_pack(t := turn, span := span, topic := topic, key := key) ORDER BY turn) AS rem FROM i WHERE turn % 2 = 1 GROUP BY 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM i WHERE turn % 2 = 0),
    w AS (SELECT conv_id, 0::BIGINT AS n, rem, NULL::BIGINT AS gold, NULL::BIGINT AS predicted, 0 AS score FROM p
      UNION ALL SELECT w.conv_id, g.n, CASE WHEN w.b[1] < 0 THEN list_filter(w.rem, lambda x: x.t <> w.b[2]) ELSE w.rem END, g.turn, CASE WHEN w.b[1] < 0 THEN w.b[2] END, -w.b[1]
      FROM (SELECT w.conv_id, w.rem, g.n, g.turn, list_sort(list_transform(w.rem, lambda x: [CASE WHEN x.span = g.span AND g.span <> '' THEN -3 WHEN x.topic = g.topic AND g.topic <> '' THEN -2 WHEN x.key = g.key AND g.key <> '' THEN -1 ELSE 0 END, x.t]))[1] AS b FROM w JOIN g ON g.conv_id = w.conv_id AND g.n = w.n + 1) AS w JOIN g ON g.conv_id = w.conv_id AND g.n = w.n)
    SELECT conv_id AS "case", gold, predicted, score::INTEGER AS score FROM w WHERE predicted IS NOT NULL"""


@query(_ALIGN)
def aligned_turns(spark: SparkSession, d: str) -> DataFrame:
    """Even turns of each conversation aligned with its odd ones: by how they begin, by role, by how they end."""
    text = F.coalesce("text", F.lit(""))
    items = table(spark, d, "conversations").select("conv_id", "turn", F.substring(text, 1, 2).alias("span"), F.coalesce("role", F.lit("")).alias("topic"), F.expr("right(coalesce(text, ''), 2)").alias("key"))
    return aligned(items.where("turn % 2 = 0"), items.where("turn % 2 = 1"), "conv_id", "turn", {"span": 3, "topic": 2, "key": 1})
