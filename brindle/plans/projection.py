"""Driver queries for profiles kept up by revisions, over the documents as facts, with their SQL.

A document is a fact of its source about its language.  A first batch holds all but the odd documents
in French and German; a second brings those and new contents of the even German ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import projection as P
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


_LATE = "facet IN ('fr', 'de') AND id % 2 = 1"
_CHANGED = "facet = 'de' AND id % 2 = 0"


def _time(day: int):
    return F.to_timestamp(F.lit(f"2024-06-0{day} 00:00:00"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    base = F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return table(spark, d, "documents").select(
        i.alias("id"), F.coalesce("source", F.lit("")).alias("space"), P.facet_name(F.col("lang")).alias("facet"), F.coalesce("text", F.lit("")).alias("content"),
        (i % 5 / 4.0).alias("importance"), (i % 7 / 6.0).alias("confidence"), F.timestamp_seconds(base + F.floor(i / 8) * 60).alias("updated_at"),
    )


def _renewed(facts: DataFrame) -> DataFrame:
    changed = F.expr(_CHANGED)
    return facts.withColumns({"content": F.when(changed, F.concat(F.lit("neu "), "content")).otherwise(F.col("content")), "updated_at": F.when(changed, F.timestamp_add("DAY", F.lit(400), "updated_at")).otherwise(F.col("updated_at"))})


def _two_batches(spark: SparkSession, d: str, only: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projections, sources and facts after two batches, of which the second rebuilds the facets that pass `only`."""
    facts = _facts(spark, d)
    first = facts.where(f"NOT ({_LATE})")
    state = P.mark_dirty(spark.createDataFrame([], P.SCHEMA), first, _time(1))
    asked = P.due(state, _time(2))
    state = P.save(state, P.build(first, asked), _time(2))
    sources = P.sources_after(first.select(*P.KEYS, "id").limit(0), first, asked)
    facts = _renewed(facts)
    state = P.mark_dirty(state, facts.where(f"({_LATE}) OR ({_CHANGED})"), _time(3))
    asked = P.due(state, _time(4)).where(only)
    return P.save(state, P.build(facts, asked), _time(4)), P.sources_after(sources, facts, asked), facts


_LINE = "trim(content, E' \\t\\r\\n\\x0b\\x0c')"
_A = f"""z AS (SELECT doc_id AS id, coalesce(source, '') AS space, coalesce(nullif(trim(lang, E' \\t\\r\\n\\x0b\\x0c'), ''), 'other') AS facet, coalesce(text, '') AS content, doc_id % 5 / 4::DOUBLE AS importance, doc_id % 7 / 6::DOUBLE AS confidence,
    TIMESTAMP '2024-01-01' + (doc_id // 8) * INTERVAL 1 MINUTE AS updated_at FROM documents),
    y AS (SELECT * EXCLUDE (content, updated_at), CASE WHEN {_CHANGED} THEN 'neu ' || content ELSE content END AS content, CASE WHEN {_CHANGED} THEN updated_at + INTERVAL 400 DAY ELSE updated_at END AS updated_at FROM z)"""


def _packed_sql(facts: str, most: int = 24) -> str:
    return f"""(SELECT *, CASE WHEN length(content) > 480 THEN 481 ELSE length(content) END AS size, sum(CASE WHEN length(content) > 480 THEN 481 ELSE length(content) END) OVER (PARTITION BY space, facet ORDER BY place) AS upto
    FROM (SELECT *, row_number() OVER (PARTITION BY space, facet ORDER BY updated_at DESC, importance DESC, confidence DESC, id DESC) AS place FROM {facts}) WHERE place <= {most} QUALIFY upto <= 6000 AND upto - size < 6000)"""


def _built_sql(facts: str) -> str:
    return f"""(SELECT space, facet, coalesce(substring(string_agg({_LINE}[:500], '；' ORDER BY place) FILTER (place <= 4 AND {_LINE} <> ''), 1, 500), '') AS summary, string_agg(id::VARCHAR, ',' ORDER BY place) FILTER (place <= 8) AS current_ids, count(*) AS taken
    FROM {_packed_sql(facts)} GROUP BY 1, 2)"""


@query(f"""WITH {_A}, c AS (SELECT space, facet, count(*) AS fact_count, count(*) + count(*) FILTER ({_CHANGED}) AS revision FROM y GROUP BY 1, 2)
    SELECT space, facet, summary, current_ids, fact_count, fact_count - taken AS truncated_count, revision AS processed_revision, revision AS target_revision, 'fresh' AS status FROM c JOIN {_built_sql("y")} USING (space, facet)""")
def profile_projection(spark: SparkSession, d: str) -> DataFrame:
    """Facets after two batches, of which the second rebuilt those that it changed: as if all were built anew."""
    return _two_batches(spark, d)[0].drop("dirty_since", "updated_at")


@query(f"""WITH {_A}, o AS (SELECT * FROM z WHERE NOT ({_LATE})), s AS (SELECT * FROM {_built_sql("o")} WHERE facet <> 'fr' UNION ALL SELECT * FROM {_built_sql("y")} WHERE facet = 'fr'),
    n AS (SELECT * FROM y WHERE facet = 'de' AND id % 2 = 1), l AS (SELECT space, facet, 0 AS place, summary AS line FROM s WHERE summary <> '' UNION ALL SELECT space, facet, place, '【最新】' || content FROM {_packed_sql("n", 5)}),
    g AS (SELECT space, line, min(struct_pack(f := facet, p := place)) AS first_at FROM l GROUP BY 1, 2)
    SELECT space, row_number() OVER (PARTITION BY space ORDER BY first_at, line)::INTEGER AS line_no, line FROM g QUALIFY line_no <= 10""")
def profile_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every profile while German waits to be rebuilt: old summaries, then its newest facts."""
    return P.profile_lines(*_two_batches(spark, d, "facet = 'fr'"))
