"""Driver queries for relational access paths, aggregates and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scores import linear_percentiles, order_statistics
from brindle.functions.sensitive import PATTERNS
from brindle.functions.text import iso_period
from brindle.operators import relational as R
from brindle.operators.metrics import conservation
from brindle.sources.tables import append_once, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The pattern with a look-ahead as SQL that has none: a value after a label, then a digit in it.
SPACE_VALUE_SQL = "len(list_filter(regexp_extract_all(text, '(?i)(?:密码|口令|私钥|密钥|api[_ -]?key|access[_ -]?key|token|secret|password)\\s+([^\\s，。；;]{8,})', 1), lambda x: regexp_matches(x, '\\d'))) > 0"
SENSITIVE_SQL = "coalesce(" + " OR ".join(SPACE_VALUE_SQL if "(?=" in p[0] else "regexp_matches(text, '" + p[0].replace("'", "''") + "')" for p in PATTERNS) + ", false)"


@query(f"""WITH c AS (SELECT d.doc_id, d.source, d.text FROM documents d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)),
    f AS (SELECT * FROM c ORDER BY doc_id DESC LIMIT 100)
    SELECT doc_id, source FROM f WHERE NOT {SENSITIVE_SQL} ORDER BY doc_id DESC LIMIT 25""")
def filter_notes_type_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "labels").where("quality = 1 AND toxic = 0")
    notes = table(spark, d, "documents").join(flagged, "doc_id", "left_semi")
    return R.note_filter(notes, F.col("lang") == "en", ["doc_id"], 25).select("doc_id", "source")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 30")
def list_recent_events(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "events").where(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 7 DAYS"))
    return R.newest(recent, ["ts", "event_id"], 30).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def memory_list_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(table(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_orderdate", "o_orderkey"], R.clamp(100, 1, 100)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC LIMIT 50")
def exact_first_order(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return table(spark, d, "orders").orderBy(first, F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_tags FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def tags_all_division(spark: SparkSession, d: str) -> DataFrame:
    return R.with_all_tags(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT o_orderkey, coalesce(parts, '') AS parts FROM orders LEFT JOIN
    (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def attach_children_agg(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    found = R.attach_list(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber"], "l_partkey", "parts")
    return found.select("o_orderkey", F.array_join("parts", ",").alias("parts"))


@query("""WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, min(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2),
    b AS (SELECT source AS id, target AS other, seen, 'out' AS way FROM e WHERE target IN (SELECT p_partkey FROM part) UNION ALL SELECT target, source, seen, 'in' FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY seen, other) AS rk FROM b WHERE id IN (SELECT s_suppkey FROM supplier))
    SELECT id, way, other, rk::INTEGER AS rank FROM r WHERE rk <= 5""")
def one_hop_links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.min("l_shipdate").alias("at"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return R.neighbours(nodes, edges, table(spark, d, "part").select(F.col("p_partkey").alias("id")), 5).select("id", "way", "other", "rank")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
    j AS (SELECT a.conv_id, a.turn, a.role, b.turn AS prev_seq, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS rk
          FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.role = b.role AND b.place < a.place AND b.place >= a.place - 12)
    SELECT conv_id, turn, role, (-rk)::INTEGER AS "offset", prev_seq FROM j WHERE rk <= 3""")
def previous_turns(spark: SparkSession, d: str) -> DataFrame:
    return R.previous_of_sender(table(spark, d, "conversations"), 12, 3, "conv_id", "turn", "role")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def pending_antijoin(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, coalesce(m, 0) AS latest, greatest(coalesce(m, 0) - c_custkey, 0) AS lag FROM customer LEFT JOIN
    (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def outer_lag(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    spaces = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("mark"))
    return R.lag_behind(spaces, log, "c_custkey", "o_orderkey", "mark")


@query("""WITH labelled AS (SELECT DISTINCT doc_id FROM labels) SELECT item_id, (item_id IN (SELECT doc_id FROM labelled)) AS stored FROM benchmark""")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("item_id")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "benchmark").join(stored, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("stored"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def wal_append_once(spark: SparkSession, d: str) -> DataFrame:
    return append_once(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("""SELECT 'o_orderstatus' AS "by", o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM orders""")
def two_key_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS qty, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, max(greatest(l_tax - 0.02, 0)) AS over_tax
    FROM lineitem GROUP BY 1""")
def filtered_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("l_quantity").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("qty"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.max(F.greatest(F.col("l_tax") - 0.02, F.lit(0.0))).alias("over_tax")
    )


@query("""SELECT 'type' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY 2
    UNION ALL (SELECT 'tag', source, count(*) AS n FROM documents GROUP BY 2 ORDER BY n DESC, source LIMIT 20)""")
def type_tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kinds = docs.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    tags = docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)
    return kinds.unionByName(tags.select(F.lit("tag").alias("kind"), "name", "n"))


@query("""SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)
    WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 2 DAY FROM orders)""")
def memory_change_window(spark: SparkSession, d: str) -> DataFrame:
    top = R.newest(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 100)
    last = top.agg(F.max("o_orderdate").alias("last"))
    return top.crossJoin(F.broadcast(last)).where(F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 2 DAYS")).select("o_orderkey")


@query("SELECT source, count(*) AS size, max(doc_id) AS updated FROM documents GROUP BY 1 HAVING count(*) >= 3 ORDER BY size DESC, updated DESC, source LIMIT 1")
def largest_cluster(spark: SparkSession, d: str) -> DataFrame:
    return R.largest_cluster(table(spark, d, "documents"), "source", "doc_id", 3)


@query("""SELECT source, lang, count(*) AS size, count(DISTINCT toxic) AS polarities, count(DISTINCT doc_id) AS sources, max(n_chars) AS importance, least(0.9::DOUBLE, max(quality)::DOUBLE) AS confidence
    FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT toxic) <= 1""")
def cluster_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("double"))
    return R.gated_clusters(rows, ["source", "lang"], "toxic", "doc_id", 3, "n_chars", "quality")


_SORTED = "SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1"


@query(f"SELECT event_type, n, v[(round_even((n - 1) * 0.5, 0))::BIGINT + 1] AS p50, v[(round_even((n - 1) * 0.95, 0))::BIGINT + 1] AS p95 FROM ({_SORTED})")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return order_statistics(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, "nearest")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_linear(spark: SparkSession, d: str) -> DataFrame:
    found = linear_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"SELECT event_type, n, v[floor((n - 1) * 0.5)::BIGINT + 1] AS p50, v[floor((n - 1) * 0.95)::BIGINT + 1] AS p95 FROM ({_SORTED})")
def latency_floor(spark: SparkSession, d: str) -> DataFrame:
    return order_statistics(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, "floor")


@query("""WITH s AS (SELECT o_orderpriority AS step, list_sort(list(greatest(o_totalprice, 0))) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT step, n, v[(round_even((n - 1) * 0.5, 0))::BIGINT + 1] AS p50, v[(round_even((n - 1) * 0.95, 0))::BIGINT + 1] AS p95, v[(round_even((n - 1) * 0.99, 0))::BIGINT + 1] AS p99 FROM s ORDER BY step""")
def step_latency_table(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "orders").select(F.col("o_orderpriority").alias("step"), F.greatest("o_totalprice", F.lit(0.0)).alias("ms"))
    return order_statistics(steps, ["step"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest").orderBy("step")


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS rejected,
    round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0)::DOUBLE, 6) AS success_rate, CASE WHEN count(*) > 0 THEN 'measured' ELSE 'not_measured' END AS measurement_status FROM orders""")
def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda s: F.count_if(F.col("o_orderstatus") == s)
    n = F.count(F.lit(1))
    return table(spark, d, "orders").agg(hit("F").alias("success"), hit("P").alias("failed"), hit("O").alias("rejected"), F.round(hit("F") / F.nullif(n, F.lit(0)), 6).alias("success_rate"), F.when(n > 0, "measured").otherwise("not_measured").alias("measurement_status"))


@query("""SELECT count(*) AS submitted, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
    count(*) FILTER (WHERE event_type = 'click') AS pending, count(*) - count(*) FILTER (WHERE event_type IN ('purchase', 'signup', 'error', 'click')) AS conservation_delta FROM events""")
def conservation_report(spark: SparkSession, d: str) -> DataFrame:
    return conservation(table(spark, d, "events"), "event_type", {"completed": ["purchase", "signup"], "failed": ["error"], "pending": ["click"]})


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def duplicate_key_audit(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return groups.where("n >= 2")


@query("SELECT source, coalesce(nullif(lang, ''), 'other') AS facet, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1, 2")
def grouped_backfill(spark: SparkSession, d: str) -> DataFrame:
    facet = F.coalesce(F.nullif("lang", F.lit("")), F.lit("other"))
    return table(spark, d, "documents").groupBy("source", facet.alias("facet")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality <> 1) AS failed, round(count(*) FILTER (WHERE quality = 1) / nullif(count(*), 0)::DOUBLE, 4) AS pass_rate FROM labels")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    good, n = F.count_if(F.col("quality") == 1), F.count(F.lit(1))
    return table(spark, d, "labels").agg(n.alias("total"), good.alias("passed"), F.count_if(F.col("quality") != 1).alias("failed"), F.round(good / F.nullif(n, F.lit(0)), 4).alias("pass_rate"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return R.latest_per_key(orders, ["o_custkey"], ["o_orderkey"]).join(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "o_custkey")


@query("SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) - 1, max(o_orderkey)) AS watermark, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def contiguous_watermark(spark: SparkSession, d: str) -> DataFrame:
    return R.contiguous_watermark(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P")


@query("""WITH w AS (SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) - 1, max(o_orderkey)) AS watermark FROM orders GROUP BY 1)
    SELECT o_orderkey FROM orders JOIN w USING (o_custkey) WHERE o_orderstatus = 'O' AND watermark >= o_orderkey""")
def causal_gating(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    marks = R.contiguous_watermark(orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P").select("o_custkey", "watermark")
    return R.released(orders.where("o_orderstatus = 'O'"), marks, "o_custkey", "o_orderkey").select("o_orderkey")


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 20000""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return R.budget_prefix(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", F.col("n_chars"), 20_000).select("source", "doc_id", "used")


@query("SELECT strftime(ts, '%G-W%V') AS period, count(*) AS n FROM events GROUP BY 1")
def iso_week_period(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(iso_period(F.col("ts"), "week").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    last = R.newest(table(spark, d, "events"), ["ts", "event_id"], 200)
    return R.newest(last.where("event_type = 'error'"), ["ts", "event_id"], 20).select("event_id", "user_id")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_success(spark: SparkSession, d: str) -> DataFrame:
    last = R.newest(table(spark, d, "events"), ["ts", "event_id"], 200)
    return R.newest(last.where(F.col("event_type").isin("purchase", "signup")), ["ts", "event_id"], 1).select("event_id", "event_type")


@query("""SELECT doc_id, min(part) AS part FROM (SELECT doc_id, 0 AS part FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de') GROUP BY 1""")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    return R.first_wins([table(spark, d, "labels").where("quality = 0").select("doc_id"), table(spark, d, "documents").where("lang = 'de'").select("doc_id")], "doc_id")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')) AS shared,
    (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')) AS only_first""")
def id_set_operations(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "labels").where("quality = 1").select("doc_id")
    other = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return first.intersect(other).agg(F.count(F.lit(1)).alias("shared")).crossJoin(first.subtract(other).agg(F.count(F.lit(1)).alias("only_first")))


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22'""")
def time_range_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(R.time_range(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-21 10:00:00")), "week")).select("event_id")


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS brief FROM documents""")
def note_brief(spark: SparkSession, d: str) -> DataFrame:
    from brindle.functions.text import clip

    return table(spark, d, "documents").select("doc_id", clip(F.col("text"), 120).alias("brief"))
