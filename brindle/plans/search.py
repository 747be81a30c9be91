"""Driver queries for text functions, ranked retrieval and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.scores import NOTE_CHANNELS, cosine, policy_score
from brindle.functions.sensitive import PATTERNS, category_of, redacted, sensitive_reason
from brindle.operators import metrics as M
from brindle.operators import retrieval as S
from brindle.functions.sensitive import is_sensitive
from brindle.functions import terms as K
from brindle.plans.relational import SENSITIVE_SQL, SPACE_VALUE_SQL
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


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_NORM_SQL = "regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', '', 'g')"
PHRASE, TERMS = "that the", ("that", "the", "with")


@query(f"""WITH e AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE contains(lower(text), '{PHRASE}') ORDER BY doc_id DESC LIMIT 30),
    l AS (SELECT doc_id AS id, {" + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)} AS m FROM documents),
    x AS (SELECT id, row_number() OVER (ORDER BY m DESC, id DESC) AS rank FROM l WHERE m > 0 ORDER BY m DESC, id DESC LIMIT 30),
    f AS (SELECT id, round(sum(w), 6) AS rrf FROM (SELECT id, 1.55::DOUBLE / (60 + rank) AS w FROM e UNION ALL SELECT id, 0.85::DOUBLE / (60 + rank) FROM x) GROUP BY 1),
    t AS (SELECT * FROM f ORDER BY rrf DESC, id DESC LIMIT 20)
    SELECT id, rrf FROM t JOIN documents ON doc_id = id WHERE NOT {SENSITIVE_SQL} ORDER BY rrf DESC, id DESC LIMIT 10""")
def hybrid_note_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact and lexical channels over documents, fused, sensitive texts dropped, ten best."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lower("text").alias("low"))
    matched = sum((F.contains("low", F.lit(t)).cast("int") for t in TERMS), F.lit(0))
    exact = S.channel(docs.where(F.contains("low", F.lit(PHRASE))), "exact", [F.desc("id")], 30)
    lexical = S.channel(docs.withColumn("m", matched).where("m > 0"), "lexical", [F.desc("m"), F.desc("id")], 30)
    top = S.fuse([exact, lexical], NOTE_CHANNELS).orderBy(F.desc("rrf"), F.desc("id")).limit(20)
    # Cut before the filter: below a limit the patterns cannot move down to the scan of all texts.
    found = docs.join(F.broadcast(top), "id").orderBy(F.desc("rrf"), F.desc("id")).limit(20)
    return found.where(~is_sensitive(F.col("text"))).select("id", "rrf").orderBy(F.desc("rrf"), F.desc("id")).limit(10)


@query(f"SELECT doc_id, md5({_NORM_SQL}) AS norm, 'fact:' || substr(sha256({_NORM_SQL}), 1, 16) AS key FROM documents")
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.normalize_content(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5(F.col("n").cast("binary")).alias("norm"), T.fact_key(F.lit("fact"), F.col("n")).alias("key"))


@query("""SELECT doc_id, len(t)::INTEGER AS n_tokens, coalesce(t[1], '') AS first_token FROM (SELECT doc_id,
    list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}A-Za-z]+-\\d+|[A-Za-z][A-Za-z0-9+#._-]*|\\d+(?:[._-]\\d+)*'), lambda x: lower(x)))) AS t FROM documents)""")
def named_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.named_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


_TERMS_SQL = "list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9][a-z0-9+#._-]*'))"


@query(f"""WITH q AS (SELECT item_id, {_TERMS_SQL} AS t FROM benchmark), qe AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM q),
    dt AS (SELECT doc_id, unnest({_TERMS_SQL}) AS w FROM documents),
    o AS (SELECT item_id, doc_id, round(count(*) / n::DOUBLE, 6) AS overlap FROM dt JOIN qe USING (w) GROUP BY 1, 2, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM o WHERE overlap >= 0.34)
    SELECT item_id AS query_id, doc_id AS id, overlap, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.lexical_terms(F.col("text")).alias("terms"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.lexical_terms(F.col("text")).alias("terms"))
    return S.term_overlap_topk(queries, docs, 5, 0.34)


@query(f"""WITH c AS (SELECT conv_id, turn, list_filter(list_distinct(string_split({_NORM_SQL}, '')), lambda x: x <> '') AS s FROM conversations),
    p AS (SELECT a.conv_id, a.turn, b.turn AS other, round(len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0)::DOUBLE, 6) AS score
          FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, other) AS rank FROM p WHERE score >= 0.18)
    SELECT conv_id, turn, other, score FROM r WHERE rank <= 3""")
def char_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with its most similar earlier turns, by the characters they use."""
    sets = table(spark, d, "conversations").select("conv_id", "turn", T.char_set(F.col("text")).alias("s"))
    other = sets.select("conv_id", F.col("turn").alias("other"), F.col("s").alias("o"))
    scored = sets.join(other, "conv_id").where("other < turn").select("conv_id", "turn", "other", F.round(T.jaccard(F.col("s"), F.col("o")), 6).alias("score")).where("score >= 0.18")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "other"))).where("rank <= 3").drop("rank")


@query("""SELECT doc_id, i::INTEGER AS i, clause FROM (SELECT doc_id, unnest(c) AS clause, generate_subscripts(c, 1) - 1 AS i FROM (SELECT doc_id,
    (list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;，,]'), lambda p: trim(regexp_replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '^(?:并且|而且|但是|不过|同时|然后|接着|另外|还|以及|，|,)\\s*', ''))), lambda p: length(p) > 2)) AS c FROM documents))""")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.clauses(F.col("text"), None)).alias("i", "clause"))


_LOOKAHEAD = SPACE_VALUE_SQL


def _case_sql(value: int) -> str:
    parts = []
    for row in PATTERNS:
        test = _LOOKAHEAD if "(?=" in row[0] else "regexp_matches(text, '" + _q(row[0]) + "')"
        parts.append(f"WHEN {test} THEN '{row[value]}'")
    return "CASE " + " ".join(parts) + " END"


@query(f"SELECT doc_id, {_case_sql(1)} AS category, {_case_sql(2)} AS reason FROM documents")
def sensitive_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sensitive_reason(F.col("text")).alias("reason")).select("doc_id", category_of(F.col("reason")).alias("category"), "reason")


def _redacted_sql() -> str:
    out = "text"
    for pattern, _, _, new in PATTERNS:
        if "(?=" in pattern:
            # Without look-ahead: every value that has a digit, whichever of its places that is.
            labels = pattern.split(r"\s+(?=")[0]
            out = f"regexp_replace({out}, '{_q(labels)}\\s+([^\\s，。；;\\d]*\\d[^\\s，。；;]{{7,}}|[^\\s，。；;\\d]{{1}}[^\\s，。；;\\d]*\\d[^\\s，。；;]{{6,}}|" + "|".join(f"[^\\s，。；;\\d]{{{k},}}\\d[^\\s，。；;]{{{7 - k},}}" for k in range(2, 8)) + f")', '\\1 [REDACTED]', 'g')"
        else:
            out = f"regexp_replace({out}, '{_q(pattern)}', '{new.replace('$', chr(92))}', 'g')"
    return out


@query(f"WITH r AS (SELECT doc_id, text, {_redacted_sql()} AS safe FROM documents) SELECT doc_id, md5(safe) AS safe_md5 FROM r WHERE text <> safe")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", redacted(F.col("text")).alias("safe"))
    return docs.where("text <> safe").select("doc_id", F.md5(F.col("safe").cast("binary")).alias("safe_md5"))


@query("""WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''),
        lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM part),
    q AS (SELECT t AS qt FROM g ORDER BY p_partkey LIMIT 1),
    s AS (SELECT p_partkey, round(len(list_intersect(t, qt)) / (len(t) + len(qt) - len(list_intersect(t, qt)))::DOUBLE, 6) AS similarity FROM g, q)
    SELECT p_partkey, similarity FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, p_partkey LIMIT 30""")
def trigram_channel(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names resemble that of the first part."""
    parts = table(spark, d, "part").select("p_partkey", T.trigrams(F.col("p_name")).alias("t"))
    first = parts.orderBy("p_partkey").limit(1).select(F.col("t").alias("q"))
    scored = parts.crossJoin(F.broadcast(first)).select("p_partkey", F.round(T.jaccard(F.col("t"), F.col("q")), 6).alias("similarity")).where("similarity >= 0.3")
    return scored.orderBy(F.desc("similarity"), "p_partkey").limit(30)


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_TOPK = f"""SELECT query_id, id, score, label, qlabel, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS qlabel, b.label AS label, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.where("id % 100 = 0"), vectors


@query(f"SELECT query_id, id, score, rank FROM ({_TOPK})")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every query (ids divisible by 100), exact, against all rows."""
    return S.cosine_topk(*_vectors(spark, d), 10)


@query(f"""SELECT label, id, score FROM (SELECT b.label, b.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY b.label ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0) WHERE rank <= 3""")
def vector_channel_by_label(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    seed = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vectors.where("vec_id <> 0").crossJoin(F.broadcast(seed)).select("label", F.col("vec_id").alias("id"), F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).where("rank <= 3").drop("rank")


def cover_sql(pairs: str, keys: str) -> str:
    """CTE `cover` (the keys, cd): the cover-density rank of every row of `pairs` by its words `ws` in order for the distinct words `words`."""
    return f"""hit AS (SELECT {keys}, words, word, at_, row_number() OVER (PARTITION BY {keys} ORDER BY at_) AS n_ FROM (SELECT {keys}, words, unnest(ws) AS word, generate_subscripts(ws, 1) AS at_ FROM {pairs}) WHERE list_contains(words, word)),
    seen AS (SELECT {keys}, at_, n_, len(words) AS need, max(CASE WHEN word = term THEN at_ END) OVER o AS last_at, max(CASE WHEN word = term THEN n_ END) OVER o AS last_n FROM (SELECT *, unnest(words) AS term FROM hit) WINDOW o AS (PARTITION BY {keys}, term ORDER BY at_)),
    run AS (SELECT {keys}, at_, n_, min(last_at) AS from_at, min(last_n) AS from_n FROM seen GROUP BY {keys}, at_, n_, need HAVING count(last_at) = need),
    cover AS (SELECT {keys}, round(sum(0.1::DOUBLE / (1 + (to_at - from_at) - (to_n - from_n))), 9) AS cd FROM (SELECT {keys}, from_at, from_n, min(at_) AS to_at, min(n_) AS to_n FROM run GROUP BY ALL) GROUP BY {keys})"""


_THREE = f"""e AS (SELECT doc_id AS id, 'exact' AS ch, 1.60::DOUBLE AS w, row_number() OVER (ORDER BY doc_id DESC) AS rk FROM documents WHERE contains(lower(text), 'license')),
    s AS (SELECT doc_id AS id, 'structured' AS ch, 1.35::DOUBLE AS w, row_number() OVER (ORDER BY doc_id DESC) AS rk FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
    kw AS (SELECT doc_id, ws, ['that', 'the'] AS words FROM k WHERE list_contains(ws, 'that') AND list_contains(ws, 'the')), {cover_sql("kw", "doc_id")},
    v AS (SELECT doc_id AS id, 'fts' AS ch, 1.00::DOUBLE AS w, row_number() OVER (ORDER BY cd DESC, doc_id DESC) AS rk FROM cover),
    a AS (SELECT * FROM e WHERE rk <= 30 UNION ALL SELECT * FROM s WHERE rk <= 30 UNION ALL SELECT * FROM v WHERE rk <= 30),
    f AS (SELECT id, round(sum(w / (60 + rk)), 6) AS rrf, count(DISTINCT ch)::INTEGER AS channels, min(CASE WHEN ch = 'exact' THEN rk END)::INTEGER AS exact_rank FROM a GROUP BY 1)"""


def _three_channels(spark: SparkSession, d: str) -> DataFrame:
    from brindle.functions.scores import MEMORY_CHANNELS

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    exact = S.channel(docs.where(F.contains(F.lower("text"), F.lit("license"))), "exact", [F.desc("id")], 30)
    structured = S.channel(docs.join(toxic, "id", "left_semi"), "structured", [F.desc("id")], 30)
    asked = F.array(F.lit("that"), F.lit("the"))
    matched = docs.withColumn("words", K.lexemes(F.col("text"))).where(K.plain_match(F.col("words"), asked)).withColumn("fts_rank", K.rank_cover(F.col("words"), asked))
    return S.fuse([exact, structured, S.channel(matched, "fts", [F.desc("fts_rank"), F.desc("id")], 30)], MEMORY_CHANNELS)


_COVERED = (["that", "the"], ["the", "license", "notice"], ["der"])


@query(f"""WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents), q AS (SELECT unnest({[list(w) for w in _COVERED]}) AS words),
    m AS (SELECT *, array_to_string(words, ' ') AS query FROM k, q WHERE len(list_intersect(ws, words)) = len(words)), {cover_sql("m", "doc_id, query")} SELECT query, doc_id, cd AS rank FROM cover""")
def cover_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The full-text rank of every document that has all words of a query, for three queries."""
    rows = table(spark, d, "documents").select("doc_id", K.lexemes(F.col("text")).alias("words"))
    asked = F.array(*[F.array(*[F.lit(w) for w in words]) for words in _COVERED])
    pairs = rows.withColumn("asked", F.explode(asked)).where(K.plain_match(F.col("words"), F.col("asked")))
    return pairs.select(F.array_join("asked", " ").alias("query"), "doc_id", K.rank_cover(F.col("words"), F.col("asked")).alias("rank"))


@query(f"WITH {_THREE} SELECT id, rrf, channels, coalesce(exact_rank, 0) AS exact_rank FROM f")
def rrf_three_channels(spark: SparkSession, d: str) -> DataFrame:
    return _three_channels(spark, d).withColumn("exact_rank", F.coalesce("exact_rank", F.lit(0)))


@query(f"""WITH {_THREE}, m AS (SELECT f.*, coalesce(quality, 0)::DOUBLE AS imp FROM f LEFT JOIN labels ON doc_id = id),
    p AS (SELECT *, round(0.72 * 0.5 + 0.08 * 1.0 + 0.07 * imp + 0.05 * 1.0 + 0.05 * 0.8 + 0.03 * 0.0, 4) AS policy FROM m)
    SELECT id, rrf, channels, coalesce(exact_rank, 0) AS exact_rank, round(least(1.0, CASE WHEN exact_rank IS NOT NULL THEN greatest(b, 0.98 - 0.005 * greatest(0, exact_rank - 1)) ELSE b END)::DOUBLE, 4) AS final
    FROM (SELECT *, 0.52::DOUBLE * policy + 0.48::DOUBLE * least(1.0, rrf / max(rrf) OVER () + 0.04::DOUBLE * greatest(0, channels - 1)) AS b FROM p)""")
def final_rerank(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("imp"))
    hits = _three_channels(spark, d).join(labels, "id", "left").withColumn("query_id", F.lit(0))
    policy = policy_score(F.lit(0.5), F.lit(1.0), F.coalesce("imp", F.lit(0.0)), F.lit(1.0), F.lit(0.8), F.lit(0), F.lit(1.0))
    return S.rerank(hits, policy, "query_id").select("id", "rrf", "channels", F.coalesce("exact_rank", F.lit(0)).alias("exact_rank"), "final")


@query("""SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN round((0.72 * quality + 0.08 * toxic + 0.07 * least(n_chars / 1000.0, 1.0) + 0.05 * 0.1 + 0.05 * 0.9 + 0.03 * least((doc_id % 20) / 10.0, 1.0))::DOUBLE * CASE WHEN toxic = 1 THEN 0.5 ELSE 1.0 END, 4)
    ELSE 0.0 END::DOUBLE AS score FROM documents JOIN labels USING (doc_id)""")
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    score = policy_score(F.col("quality"), F.col("toxic"), F.least(F.col("n_chars") / 1000.0, F.lit(1.0)), F.lit(0.1), F.lit(0.9), F.col("doc_id") % 20, F.when(F.col("toxic") == 1, 0.5).otherwise(1.0))
    return rows.select("doc_id", score.cast("double").alias("score"))


@query(f"""WITH t AS ({_TOPK}), h AS (SELECT qlabel AS question, (query_id % 3 > 0)::INT AS part, id, score, rank FROM t),
    f AS (SELECT question, id, round(max(CASE WHEN part = 0 THEN 1.0 ELSE 0.92 END::DOUBLE * (0.70::DOUBLE * score + 0.30::DOUBLE / rank)) + least(0.12::DOUBLE, 0.03::DOUBLE * (count(*) - 1)), 4) AS score, count(*) AS appearances FROM h GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("question"))
    hits = S.cosine_topk(*_vectors(spark, d), 10).join(labels, "query_id")
    return S.fuse_queries(hits.withColumn("part", (F.col("query_id") % 3 > 0).cast("int")), 5)


@query(f"""WITH t AS ({_TOPK}) SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 1 THEN score END) < 0.58 OR
    (max(CASE WHEN rank = 1 THEN score END) < 0.75 AND max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) < 0.04), true) AS low_quality FROM t GROUP BY 1""")
def low_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.low_quality(S.cosine_topk(*_vectors(spark, d), 10))


@query(f"""WITH t AS ({_TOPK}), n AS (SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1),
    i AS (SELECT query_id, n, (SELECT sum(1 / log2(k + 1)) FROM range(1, least(n, 10) + 1) r(k)) AS ideal FROM n)
    SELECT query_id, {", ".join(f"round(count(*) FILTER (WHERE label = qlabel AND rank <= {k}) / {k}::DOUBLE, 6) AS precision_{k}, round(count(*) FILTER (WHERE label = qlabel AND rank <= {k}) / any_value(n)::DOUBLE, 6) AS recall_{k}, (count(*) FILTER (WHERE label = qlabel AND rank <= {k}) > 0)::INTEGER AS hit_{k}" for k in (1, 3, 5, 10))},
    round(coalesce(1 / min(CASE WHEN label = qlabel THEN rank END)::DOUBLE, 0), 6) AS mrr, round(coalesce(sum(CASE WHEN label = qlabel THEN 1 / log2(rank + 1) END) / any_value(ideal), 0), 6) AS ndcg_10
    FROM t LEFT JOIN i USING (query_id) GROUP BY 1""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and hit at 1, 3, 5, 10, reciprocal rank and nDCG of the exact nearest vectors."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    hits = S.cosine_topk(*_vectors(spark, d), 10).join(rows, "id").join(asked, "query_id").withColumn("relevant", F.coalesce(F.col("label") == F.col("wanted"), F.lit(False)))
    of_label = rows.groupBy(F.col("label").alias("wanted")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return M.class_retrieval_scores(hits, asked.join(of_label, "wanted").select("query_id", "n_relevant"), [1, 3, 5, 10])


_SCORED = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp)::DOUBLE, 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END AS recall"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1"


@query(f"""WITH g AS (SELECT lang AS k, count(*) AS g FROM documents GROUP BY 1), p AS (SELECT lang AS k, count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    b AS (SELECT sum(least(coalesce(g, 0), coalesce(p, 0)))::BIGINT AS tp, sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0))::BIGINT AS fn FROM g FULL JOIN p USING (k)),
    s AS (SELECT *, {_SCORED} FROM b) SELECT *, {_F1} FROM s""")
def multiset_prf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return M.multiset_scores(docs, docs.join(table(spark, d, "labels"), "doc_id"), "lang")


@query(f"""WITH r AS (SELECT quality = 1 AS g, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM r),
    s AS (SELECT *, {_SCORED} FROM b) SELECT *, {_F1} FROM s""")
def binary_prf(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return M.binary_scores(rows, F.col("quality") == 1, F.col("n_chars") > 500)


_GUESS = "CASE WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr' WHEN contains(lower(text), ' los ') THEN 'es' ELSE 'en' END"


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return table(spark, d, "documents").select("lang", F.when(has(" der "), "de").when(has(" les "), "fr").when(has(" los "), "es").otherwise("en").alias("guess"))


@query(f"""WITH r AS (SELECT CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'other' END AS gold, CASE WHEN g IN ('en', 'de', 'fr') THEN g ELSE 'other' END AS p FROM (SELECT lang, {_GUESS} AS g FROM documents))
    SELECT gold, count(*) FILTER (WHERE p = 'en') AS en, count(*) FILTER (WHERE p = 'de') AS de, count(*) FILTER (WHERE p = 'fr') AS fr, count(*) FILTER (WHERE p = 'other') AS other FROM r GROUP BY 1""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_guessed(spark, d), "lang", "guess", ["en", "de", "fr"])


@query(f"""WITH r AS (SELECT lang AS g, {_GUESS} AS p FROM documents), l AS (SELECT g AS label FROM r UNION SELECT p FROM r),
    b AS (SELECT label, count(*) FILTER (WHERE g = label AND p = label) AS tp, count(*) FILTER (WHERE g <> label AND p = label) AS fp, count(*) FILTER (WHERE g = label AND p <> label) AS fn FROM l, r GROUP BY 1),
    s AS (SELECT *, {_SCORED} FROM b) SELECT *, {_F1} FROM s""")
def per_label_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.per_label_scores(_guessed(spark, d), "lang", "guess")
