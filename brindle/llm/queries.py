"""The corpus queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import crc_mod, table
from brindle.llm.byte_pairs import decode as decode_pairs
from brindle.llm.byte_pairs import encode as encode_pairs
from brindle.llm.centroids import cluster
from brindle.llm.chat_format import format_chats, read_back
from brindle.llm.exact_dedup import exact_groups
from brindle.llm.jaccard_join import jaccard_groups
from brindle.llm.language_id import identify, train
from brindle.llm.lm_scoring import score as lm_score
from brindle.llm.mixing import Targets, mix
from brindle.llm.prefix_trie import prefix_trie
from brindle.llm.quality_model import fit, labelled_sample, score
from brindle.llm.quality_rules import judged
from brindle.llm.sentence_pieces import encode
from brindle.llm.sharding import shard_rows

#: The public vocabulary that the queries encode with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: Domains by source number, and the targets of the mix.
DOMAINS = ("web", "reference", "books")
TARGETS = Targets(domain={"web": 0.5, "reference": 0.3, "books": 0.2}, language={"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, source={})


def domain_of(source: Column) -> Column:
    """The domain that a source name stands for: its number modulo 3; others are web."""
    number = F.try_to_number(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("999999999")).cast("long")
    found = F.lit(DOMAINS[0])
    for i, name in enumerate(DOMAINS[1:], start=1):
        found = F.when(number % len(DOMAINS) == i, F.lit(name)).otherwise(found)
    return found


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mix(docs, domain_of(F.col("source")), TARGETS)
    return chosen.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_budget").alias("leaf_budget"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own control strings."""
    tricky = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql("SELECT -7L AS conv_id, id AS turn, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role FROM range(2)").withColumn("text", F.lit(tricky)))
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit(None).cast("long").alias("message_id"), F.lit("message").alias("kind"), "role", "text")
    chats = read_back(format_chats(events))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = fit(labelled_sample(docs, labels))
    scored = score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), percent=90, n=3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether decoding them gives the text back."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL, check=True)
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=16, dims=64, scale=64, rounds=3)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, packed=True)
    coded = coded.select("doc_id", "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"))
    return decode_pairs(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_model": op2_quality_model,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH rows AS (
          SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') AS body FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(4 + length(role) + 2 + length(body) + 8)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
        k AS MATERIALIZED (SELECT min(r) AS r, min(doc_id) AS low, md5(array_to_string(list_sort(sh), chr(10))) AS h, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY md5(array_to_string(list_sort(sh), chr(10)))),
        e AS MATERIALIZED (SELECT r, len(sh) AS n, unnest(sh) AS g FROM k),
        p AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        l AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        c AS (SELECT r AS x, r AS y FROM k WHERE r IN (SELECT x FROM l) UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
        m AS (SELECT c.x AS r, min(k.low) AS component_id FROM c JOIN k ON k.r = c.y GROUP BY 1),
        n AS (SELECT x AS r, count(*) AS n_links FROM l GROUP BY 1)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component_id, k.low, s.doc_id) AS component_id, coalesce(k.low, s.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
        FROM s LEFT JOIN k ON k.h = md5(array_to_string(list_sort(s.sh), chr(10))) AND len(s.sh) > 0 LEFT JOIN m ON m.r = k.r LEFT JOIN n ON n.r = k.r""",
    "op6_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
        v AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS rep
              FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM q WHERE n > 1) GROUP BY 1),
        ln AS (SELECT doc_id, host, t, trim(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS l FROM (SELECT doc_id, host, t, unnest(ls) AS x FROM w)),
        lc AS (SELECT host, l, count(DISTINCT t) AS texts, min(doc_id) AS carrier FROM ln GROUP BY 1, 2),
        hs AS (SELECT host, count(DISTINCT t) AS host_texts FROM d GROUP BY 1),
        fr AS (SELECT lc.* FROM lc JOIN hs USING (host) WHERE texts > 5 AND texts > 0.1 * host_texts),
        rm AS (SELECT ln.doc_id, sum(length(l) - length(replace(l, ' ', '')) + 1)::BIGINT AS removed FROM ln JOIN fr USING (host, l) WHERE ln.doc_id <> fr.carrier GROUP BY 1),
        b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM w),
        f AS (SELECT b.*, coalesce(rep, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(rep, 0) > 30 * n_words AS base_failed, coalesce(removed, 0) AS removed_words
              FROM b LEFT JOIN v USING (doc_id) LEFT JOIN rm USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
               NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < 20) AS kept FROM f""",
    "op9_sharding": r"""
        WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(range(4), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS tab FROM range(16) r(i)),
        d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
        h AS (SELECT *, hex(encode(t)) AS x, md5(t) AS m FROM d),
        c AS (SELECT r, doc_id, length(x) // 2 + 16 AS size, m,
                     xor(list_reduce(list_transform(range(length(x)), lambda i: ('0x' || substr(x, i + 2 - 2 * (i % 2), 1))::BIGINT), lambda s, b: xor(s // 16, tab[xor(s % 16, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
              FROM h, tab),
        w AS (SELECT r, (CASE WHEN k < 0 THEN k + 18446744073709551616 ELSE k END)::HUGEINT AS k, 0::BIGINT AS b, 0::BIGINT AS j
              FROM (SELECT r, coalesce(doc_id, ('0x' || substr(m, 1, 15))::BIGINT)::HUGEINT AS k FROM c)
              UNION ALL
              SELECT r, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
              FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM w WHERE j < 40)),
        f AS (SELECT r, b, j FROM w WHERE j >= 40)
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, b::INTEGER AS shard,
               row_number() OVER (PARTITION BY b ORDER BY substr(m, 1, 16), doc_id NULLS FIRST) - 1 AS slot, (CASE WHEN j = 40 THEN 40 ELSE b END)::INTEGER AS grown_shard
        FROM c JOIN f USING (r)""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, lang, source, (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT), 0) % 3) AS m,
                          len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS t FROM documents),
        r AS (SELECT doc_id, CASE m WHEN 1 THEN 'reference' WHEN 2 THEN 'books' ELSE 'web' END AS domain, lang, source, t FROM d),
        lf AS (SELECT domain, lang, source, sum(t)::BIGINT AS t, 2 * sum(t)::BIGINT AS lim FROM r GROUP BY ALL),
        dm AS (SELECT domain, sum(lim)::BIGINT AS lim, CASE domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'reference' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w,
                      (SELECT floor(sum(t) * 0.6::DOUBLE) FROM lf) AS b FROM lf GROUP BY 1),
        d1 AS (SELECT *, (b - coalesce(sum(lim) OVER (ORDER BY lim / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY lim / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM dm),
        d2 AS (SELECT domain, least(lim::DOUBLE, w * (SELECT greatest(max(lv), 0) FROM d1)) AS b FROM d1),
        lg AS (SELECT domain, lang, sum(lim)::BIGINT AS lim, CASE lang WHEN 'en' THEN 0.4::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'es' THEN 0.2::DOUBLE ELSE 1.0 END AS w FROM lf GROUP BY 1, 2),
        l1 AS (SELECT lg.*, (b - coalesce(sum(lim) OVER (PARTITION BY domain ORDER BY lim / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (PARTITION BY domain ORDER BY lim / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM lg JOIN d2 USING (domain)),
        l2 AS (SELECT domain, lang, least(lim::DOUBLE, w * greatest(max(lv) OVER (PARTITION BY domain), 0)) AS b FROM l1),
        s1 AS (SELECT lf.*, (b - coalesce(sum(lim) OVER (PARTITION BY domain, lang ORDER BY lim, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / count(*) OVER (PARTITION BY domain, lang ORDER BY lim, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM lf JOIN l2 USING (domain, lang)),
        s2 AS (SELECT domain, lang, source, t AS leaf_t, floor(round(least(lim::DOUBLE, greatest(max(lv) OVER (PARTITION BY domain, lang), 0)), 6))::BIGINT AS leaf_budget FROM s1),
        s3 AS (SELECT *, CASE WHEN leaf_t > 0 THEN leaf_budget // leaf_t ELSE 0 END AS whole FROM s2),
        h AS (SELECT r.*, leaf_budget, whole, leaf_budget - whole * leaf_t AS rest, ('0x' || substr(md5('17:' || (whole + 1) || ':' || doc_id || ':' || r.t), 1, 15))::BIGINT AS hash
              FROM r JOIN s3 ON r.domain = s3.domain AND r.lang = s3.lang AND r.source = s3.source),
        p AS (SELECT *, whole + CASE WHEN sum(t) OVER (PARTITION BY domain, lang, source ORDER BY hash) <= rest THEN 1 ELSE 0 END AS times FROM h)
        SELECT doc_id, domain, lang, source, unnest(range(1, times + 1))::INTEGER AS epoch, t AS n_tokens, leaf_budget FROM p WHERE times > 0""",
    "op11_centroid_clustering": """
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept) WHERE c < 16),
""" + "".join(f"""
        a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * 16 + c) AS m
                              FROM (SELECT r, vec_id, k.v AS v, c, list_sum(list_transform(list_zip(k.v, o.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{i} o) GROUP BY r),
        s{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m % 16 AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY c, i),
        c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) u USING (c)),""" for i in range(4)) + """
        f AS (SELECT vec_id, m % 16 AS c, (m // 16)::BIGINT AS distance FROM a3)
        SELECT vec_id, f.c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
        FROM f JOIN c3 ON c3.c = f.c""",
    "op12_prefix_trie": r"""
        WITH tab AS MATERIALIZED (SELECT list(list_reduce(range(4), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS tab FROM range(16) r(i)),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, sha256(length(role) || ':' || role || text) AS letter, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
        own AS MATERIALIZED (SELECT conv_id, list(letter ORDER BY i) AS ls, list(w ORDER BY i) AS ws, hex(encode(conv_id::VARCHAR)) AS x FROM l GROUP BY conv_id),
        hd AS (SELECT conv_id, ls, ws, conv_id - conv_id % 20 AS base,
                      xor(list_reduce(list_transform(range(length(x)), lambda i: ('0x' || substr(x, i + 2 - 2 * (i % 2), 1))::BIGINT), lambda s, b: xor(s // 16, tab[xor(s % 16, b) + 1]), 4294967295::BIGINT), 4294967295) % 4 AS h FROM own, tab),
        reb AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.ls[1:a.h], []), a.ls[a.h + 1:]) AS ls, list_concat(coalesce(b.ws[1:a.h], []), a.ws[a.h + 1:]) AS ws FROM hd a LEFT JOIN own b ON b.conv_id = a.base),
        pf AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(ls[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ls[1:d - 1], ',')) END AS pk, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ls) AS e
                            FROM (SELECT *, unnest(range(0, len(ls) + 1)) AS d FROM reb)),
        nd AS MATERIALIZED (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS low, count(*) AS n, (count(*) - 1) * any_value(w) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM pf GROUP BY d, k),
        ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS c FROM nd WHERE d > 0 GROUP BY 1, 2),
        lf AS (SELECT nd.*, coalesce(c, 0) AS c FROM nd LEFT JOIN ch USING (d, k)),
        up AS (SELECT pf.d, pf.k, sum((c = 0)::INT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM lf JOIN pf ON pf.conv_id = lf.low AND pf.d <= lf.d GROUP BY 1, 2)
        SELECT lf.low AS conv_id, lf.d AS depth, p.low AS parent_conv_id, lf.n AS n_convs, lf.c AS n_children, up.leaves AS n_leaves, up.saved AS saved_tokens, sha256(lf.ends) AS ends_sha256
        FROM lf JOIN up USING (d, k) LEFT JOIN nd p ON p.k = lf.pk AND p.d = lf.d - 1""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM r""",
}
