"""Hybrid search: every query against memories, notes or candidates by several channels, fused and re-ranked.

Query frames are small and are sent to all tasks; texts are read once, each row is tested for all channels in one pass, and only rows that a channel takes are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import rules, terms
from brindle.functions import text as T
from brindle.functions.scores import MEMORY_CHANNELS, NOTE_CHANNELS, policy_score, recency
from brindle.functions.sensitive import is_sensitive
from brindle.operators.retrieval import fuse, rerank

# Words of a query that hint at a memory type, in the order of the types.
TYPE_HINTS = {
    "preference": ("喜欢", "偏好", "习惯", "讨厌", "避开", "过敏"),
    "task": ("任务", "待办", "要做", "进度", "完成", "取消"),
    "semantic": ("住哪", "住在", "哪里", "项目", "学习", "研究"),
}
# Bonuses of a hit with the same key, subject and predicate; weights of a channel's width.
KEY_BONUS, SLOT_BONUS = 0.08, 0.03
QUERY_WORDS, MIN_SCORE = 500, 0.45
#: Characters of a text, beyond twice the longest key asked for, that tell whether it can have a key.
HEAD = 64
#: Lengths of the beginnings on which parts of texts meet the texts.
NEEDLE_WIDTHS = (1, 2, 4, 8)


def _listed(pairs: DataFrame, lists: list[tuple[str, Column, Column | None, int]], keys: list[str], newest: list[str]) -> DataFrame:
    """From pairs of query and row, the ranked lists (channel, test, lead, length): keys, id, channel, rank.

    A list holds the rows that pass its test, by its lead (the larger first), then the newest first.  Each
    pair is tested once for all lists, and one window ranks them all.
    """
    entry = lambda i, name, test, lead, n: F.when(test, F.struct(F.lit(i).alias("list"), F.lit(name).alias("channel"), (F.lit(0.0) if lead is None else lead.cast("double")).alias("lead"), F.lit(n).alias("length")))
    entries = F.filter(F.array(*[entry(i, *x) for i, x in enumerate(lists)]), lambda e: e.isNotNull())
    taken = pairs.select(*keys, "id", *newest, F.explode_outer(entries).alias("e")).where(F.col("e").isNotNull())
    best = Window.partitionBy(*keys, "e.list").orderBy(F.desc("e.lead"), *[F.desc(c) for c in newest], F.desc("id"))
    taken = taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(n for *_, n in lists))
    return taken.where(F.col("rank") <= F.col("e.length")).select(*keys, "id", F.col("e.channel").alias("channel"), "rank")


def memory_pairs(queries: DataFrame, memories: DataFrame, trigram: bool = False) -> DataFrame:
    """Queries (query_id, query) against memories: all pairs, with a flag for each channel and the full-text
    rank.  All queries go to each memory as one array, so that what is worked out of a text is worked out once,
    and a text is only gone through for tests that earlier ones leave open; flags are not filtered here, so that
    whoever reads them tests each pair once.

    `memories` has id, memory_type, content, memory_key, subject, predicate, object_value and updated_at.
    """
    q = F.col("query")
    hints = F.filter(F.array(*[F.when(rules.any_of(q, words), F.lit(name)) for name, words in TYPE_HINTS.items()]), lambda x: x.isNotNull())
    asked = queries.select("query_id", T.normalize_content(q).alias("q_key"), F.trim("query").alias("q_plain"), terms.identifiers(q).alias("q_ids"), terms.memory_terms(q).alias("q_terms"), hints.alias("q_types"), "query")
    asked = asked.withColumn("q_words", F.array_distinct(terms.lexemes(F.substring(F.when(F.size("q_terms") > 0, F.array_join("q_terms", " ")).otherwise(q), 1, QUERY_WORDS))))
    asked = asked.withColumns({"q_part": F.lower(F.substring("q_plain", 1, 160)), "q_all": F.array_distinct(F.transform("q_terms", lambda t: F.lower(F.substring(t, 1, 120))))})
    # A text with a needle has every needle inside that one, so those that have another inside need no test.
    asked = asked.withColumn("q_needles", F.filter("q_all", lambda t: ~F.exists("q_all", lambda o: (o != t) & F.contains(t, o))))
    needled = lambda text: F.coalesce(F.exists("q_needles", lambda t: F.contains(text, t)), F.lit(False))
    # Whether a text must have a needle to have the query, and to have all its words; the words that are seldom met first.
    asked = asked.withColumns({"part_needled": needled(F.col("q_part")), "words_needled": F.coalesce(F.exists("q_words", needled), F.lit(False)), "q_longest": F.reverse(F.array_sort(F.transform("q_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))["w"]})
    every = asked.agg(F.collect_list(F.struct(*[c for c in asked.columns if c not in ("query", "q_all")])).alias("asked"), F.coalesce(F.max(F.length("q_key")), F.lit(0)).alias("longest"))
    slots = ("content", "subject", "predicate", "object_value")
    either = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    def tested(m: Column, a: Column, in_slots: Column, in_content: Column) -> Column:
        plain = a["q_plain"] != ""
        # A text whose beginning alone has more letters than the query's key is not normalised.
        same_key = F.when(m["least"] <= F.length(a["q_key"]), T.normalize_content(F.col("content")) == a["q_key"])
        exact = either([
            plain & (F.col("memory_key") == a["q_plain"]), plain & (in_content | ~a["part_needled"]) & F.contains(m["low_content"], a["q_part"]), same_key,
            *[terms.has_identifier(c, a["q_ids"]) for c in (F.col("memory_key"), m["low_subject"], m["low_object_value"], m["low_content"])],
        ])
        lexical = in_slots | in_content
        fields = {
            "query_id": a["query_id"], "q_words": a["q_words"], "is_exact": exact, "is_hinted": F.array_contains(a["q_types"], F.col("memory_type")), "is_lexical": lexical,
            "may_match": (lexical | ~a["words_needled"]) & F.forall(a["q_longest"], lambda w: F.contains(m["document"], w)),
        }
        if trigram:
            near = lambda grams: F.aggregate(F.transform(F.slice(a["q_terms"], 1, 8), lambda t: T.let(T.trigrams(F.substring(t, 1, 120)), lambda g: T.jaccard(grams, g))), F.lit(0.0), lambda s, x: F.greatest(s, x))
            fields["similarity"] = F.greatest(near(m["grams"]), near(m["value_grams"]))
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def of_query(m: Column, a: Column) -> Column:
        has = lambda text: F.exists(a["q_needles"], lambda t: F.contains(text, t))
        found = F.struct(reduce(lambda x, y: x | y, [has(m[f"low_{c}"]) for c in slots[1:]]).alias("in_slots"), has(m["low_content"]).alias("in_content"))
        return T.let(found, lambda h: tested(m, a, h["in_slots"], h["in_content"]))

    def matched(document: Column, tests: Column) -> Column:
        # Only a text that has the letters of all words of some query is cut into words.
        kept = ("query_id", "is_exact", "is_hinted", "is_lexical", *(("similarity",) if trigram else ()))
        ranked = lambda t, words, yes: F.struct(*[t[c].alias(c) for c in kept], yes.alias("is_matched"), F.when(yes, terms.spaced_rank(words, t["q_words"])).alias("fts_rank"))
        words = F.when(F.exists(tests, lambda t: t["may_match"]), terms.spaced(document, lowered=True))
        return T.let(words, lambda ws: F.transform(tests, lambda t: T.let(t["may_match"] & terms.spaced_match(ws, t["q_words"]), lambda yes: ranked(t, ws, yes))))

    def of_memory(low: Column) -> Column:
        own = {**{f"low_{c}": low[c] for c in slots}, "document": F.concat_ws(" ", *[low[c] for c in slots]), "least": T.least_length(F.substr(low["content"], F.lit(1), 2 * F.col("longest") + HEAD))}
        if trigram:
            own |= {"grams": T.trigrams(F.col("content")), "value_grams": T.trigrams(F.col("object_value"))}
        return T.let(F.struct(*[v.alias(k) for k, v in own.items()]), lambda m: T.let(F.transform("asked", lambda a: of_query(m, a)), lambda tests: matched(m["document"], tests)))

    judged = T.let(F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in slots]), of_memory)
    pairs = memories.crossJoin(F.broadcast(every)).select(*memories.columns, F.explode_outer(judged).alias("pair"))
    return pairs.where(F.col("pair").isNotNull()).select(*memories.columns, "pair.*")


def memory_hits(queries: DataFrame, memories: DataFrame, top: int = 40, trigram: bool = False) -> DataFrame:
    """The best `top` memories of each query by weighted fusion of the exact, type-hint, lexical, full-text
    and (if asked for) trigram lists: query_id, id, rrf, channels, exact_rank."""
    n = max(30, min(120, top * 3))
    lists = [("exact", F.col("is_exact"), None, min(n, 30)), ("structured", F.col("is_hinted"), None, n), ("structured", F.col("is_lexical"), None, n), ("fts", F.col("is_matched"), F.col("fts_rank"), n)]
    if trigram:
        lists.append(("trigram", F.col("similarity") >= 0.3, F.col("similarity"), n))
    hits = fuse([_listed(memory_pairs(queries, memories, trigram), lists, ["query_id"], ["updated_at"])], MEMORY_CHANNELS, "query_id")
    hits = F.broadcast(hits).join(memories.select("id", "updated_at"), "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("updated_at"), F.desc("id"))
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place", "updated_at")


def with_bonuses(hits: DataFrame, memories: DataFrame, asked: DataFrame, query: str) -> DataFrame:
    """`hits` with bonus and score: a memory with the asked key, subject or predicate counts more."""
    rows = memories.select("id", "memory_key", "subject", "predicate")
    met = hits.join(rows, "id").join(asked.select(query, F.col("memory_key").alias("a_key"), F.col("subject").alias("a_subject"), F.col("predicate").alias("a_predicate")), query)
    same = lambda a, b: F.when((F.coalesce(F.col(a), F.lit("")) != "") & (T.normalize_content(F.col(a)) == T.normalize_content(F.col(b))), SLOT_BONUS).otherwise(0.0)
    bonus = F.when(F.col("a_key") == F.col("memory_key"), KEY_BONUS).otherwise(0.0) + same("a_subject", "subject") + same("a_predicate", "predicate")
    return met.withColumn("bonus", bonus).withColumn("score", F.round(F.col("rrf") + F.col("bonus"), 6)).drop("memory_key", "subject", "predicate", "a_key", "a_subject", "a_predicate")


def memory_score(query: Column, asof: Column) -> Column:
    """The policy score of a memory (its columns as they are) for a query.

    A preference of the other polarity scores 0; one of the asked polarity counts as on topic; a
    memory of another type than the question expects, not active, or done, counts less.
    """
    m = F.col
    is_preference = m("memory_type") == "preference"
    topics = F.array(*[T.overlap_score(query, F.coalesce(m(c), F.lit(""))) for c in ("content", "object_value", "subject", "predicate", "memory_key")])
    known = F.struct(
        F.array_max(topics).alias("topic"), rules.expected_type(query).alias("expected"), F.when(is_preference, rules.query_polarity(query)).alias("wanted"),
        F.when(is_preference, F.coalesce(m("polarity"), rules.polarity(m("content")))).alias("held"), recency(m("updated_at"), asof).alias("recent"),
    )
    done = (m("memory_type") == "task") & (m("task_status") == "done") & rules.any_of(query, rules.OPEN_TASK_WORDS) & ~rules.any_of(query, rules.CLOSED_TASK_WORDS)

    def score(k: Column) -> Column:
        intent = F.when(k["expected"] == m("memory_type"), 1.0).otherwise(0.0)
        against = ((k["wanted"] == "positive") & (k["held"] == "negative")) | ((k["wanted"] == "negative") & (k["held"] == "positive"))
        topic = F.when(k["wanted"].isin("positive", "negative") & (k["wanted"] == k["held"]) & (intent > 0), F.greatest(k["topic"], F.lit(0.45))).otherwise(k["topic"])
        mistyped = F.when(k["expected"].isNotNull() & (m("memory_type") != k["expected"]), 0.35).otherwise(1.0)
        factor = F.when(m("status") == "conflicted", 0.5).when(m("status") != "active", 0.2).otherwise(mistyped) * F.when(F.coalesce(done, F.lit(False)), 0.7).otherwise(1.0)
        return F.when(F.coalesce(against, F.lit(False)), 0.0).otherwise(policy_score(topic, intent, m("importance"), k["recent"], m("confidence"), m("access_count"), factor))

    return T.let(known, score)


def search_memories(queries: DataFrame, memories: DataFrame, asof: Column, limit: int = 10, min_score: float | None = MIN_SCORE) -> DataFrame:
    """The memories of each query after fusion and policy re-rank, exact hits first: query_id, id, final, rank.

    Hits below `min_score` go; with None all stay, as with a unified re-rank.
    """
    # The hits of a query are few, and go to the memories, whose texts stay where they are.
    hits = F.broadcast(memory_hits(queries, memories, max(4 * limit, 30))).join(memories, "id").join(F.broadcast(queries), "query_id")
    ranked = rerank(hits, memory_score(F.col("query"), asof), "query_id")
    ranked = ranked if min_score is None else ranked.where(F.col("final") >= min_score)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.col("exact_rank").isNotNull()), F.desc("final"), F.desc("rrf"), F.desc("updated_at"), F.desc("id"))
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, min(limit, 50))).select("query_id", "id", "final", "rank")


def score_linear(queries: DataFrame, memories: DataFrame, asof: Column, limit: int = 10, newest: int = 100, min_score: float = MIN_SCORE) -> DataFrame:
    """The policy score of the newest memories alone: query_id, id, score, rank."""
    rows = memories.orderBy(F.desc("updated_at"), F.desc("id")).limit(newest)
    scored = rows.crossJoin(queries).withColumn("score", memory_score(F.col("query"), asof)).where(F.col("score") >= min_score)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def search_notes(query: str, notes: DataFrame, limit: int = 8) -> DataFrame:
    """The best notes for one query by the exact, full-text and lexical lists; sensitive texts dropped after fusion: id, score.

    `notes` has id, title, summary, text, sensitivity and created_at.
    """
    limit = max(1, min(limit, 30))
    n = max(20, min(100, 4 * limit))
    cleaned = " ".join(query.split())
    asked = notes.sparkSession.range(1).select(terms.note_terms(F.lit(cleaned)).alias("q_terms"))
    q_words = F.array_distinct(terms.lexemes(F.substring(F.when(F.size("q_terms") > 0, F.array_join("q_terms", " ")).otherwise(F.lit(cleaned)), 1, QUERY_WORDS)))
    document = F.concat_ws(" ", "title", "summary", "text")
    rows = notes.where("sensitivity = 'normal'").crossJoin(asked).select("id", "created_at", "q_terms", document.alias("document"))
    rows = rows.withColumns({"words": terms.lexemes(F.col("document")), "q_words": q_words})
    rows = rows.withColumns({
        "is_exact": F.contains(F.lower("document"), F.lit(cleaned[:120].lower())), "is_matched": terms.plain_match(F.col("words"), F.col("q_words")),
        "is_lexical": terms.like_any(F.col("document"), F.col("q_terms"), 80), "query_id": F.lit(0),
    })
    rows = rows.where("is_exact OR is_matched OR is_lexical").withColumn("fts_rank", F.when(F.col("is_matched"), terms.rank_cover(F.col("words"), F.col("q_words")))).select("query_id", "id", "created_at", "is_exact", "is_matched", "is_lexical", "fts_rank")
    lists = [("exact", F.col("is_exact"), None, n), ("fts", F.col("is_matched"), F.col("fts_rank"), n), ("lexical", F.col("is_lexical"), None, n)]
    hits = fuse([_listed(rows, lists, ["query_id"], ["created_at"])], NOTE_CHANNELS, "query_id").join(notes.select("id", "text", "created_at"), "id")
    order = [F.desc("rrf"), F.desc("created_at"), F.desc("id")]
    return hits.orderBy(*order).limit(2 * limit).where(~is_sensitive(F.col("text"))).orderBy(*order).limit(limit).select("id", F.col("rrf").alias("score"))


def notes_fallback(query: str, notes: DataFrame, limit: int = 8) -> DataFrame:
    """The newest notes that match a web search string; where none does, those that contain the query or a word of it."""
    limit, cleaned = max(1, min(limit, 20)), " ".join(query.split())
    rows = notes.where("sensitivity = 'normal'").withColumn("document", F.concat_ws(" ", "title", "summary", "text"))
    order = [F.desc("created_at"), F.desc("id")]
    matched = rows.where(terms.web_match(terms.lexemes(F.col("document")), cleaned)).orderBy(*order).limit(3 * limit).withColumn("way", F.lit("words"))
    parts = list(dict.fromkeys([cleaned, *[p for p in cleaned.split() if len(p) >= 2]]))
    parts = F.array(*[F.lit(p) for p in parts if p]).cast("array<string>")
    loose = rows.where(terms.like_any(F.col("document"), parts, 80)).orderBy(*order).limit(3 * limit).withColumn("way", F.lit("parts"))
    any_match = matched.agg(F.count(F.lit(1)).alias("n_matched"))
    both = matched.unionByName(loose.crossJoin(any_match).where("n_matched = 0").drop("n_matched"))
    return both.where(~is_sensitive(F.col("text"))).orderBy(*order).limit(limit).select("id", "way")


def _containing(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of a needle (memory_type, needle) and a row (memory_type, hay, ...) of its type that has it as a part.

    They meet on the needle's first characters: as many as the widest of NEEDLE_WIDTHS that it fills.
    """
    width = reduce(lambda rest, w: F.when(F.length("needle") >= w, w).otherwise(rest), NEEDLE_WIDTHS, F.lit(0))
    asked = needles.distinct().withColumn("anchor", F.substr("needle", F.lit(1), width))
    pieces = F.concat(F.array(F.lit("")), *[F.regexp_extract_all("hay", F.lit(f"(?s)(?=(.{{{w}}}))"), F.lit(1)) for w in NEEDLE_WIDTHS])
    held = rows.withColumn("anchor", F.explode(F.array_distinct(pieces)))
    return held.join(asked, ["memory_type", "anchor"]).where(F.contains("hay", F.col("needle"))).drop("anchor", "hay")


def slot_channels(candidates: DataFrame, memories: DataFrame, top: int = 20) -> DataFrame:
    """Memories for each candidate by key, by slots, by family and, for tasks, the newest, fused with bonuses:
    candidate_id, id, score, channels.

    `candidates` has candidate_id, memory_type, memory_key, subject, predicate, object_value, entities
    and scope (JSON); `memories` the same but entities, and id, content and updated_at.

    Candidates and memories do not meet as pairs.  A list is the best of some groups of memories: those of
    one type with a key, a predicate, a key and a predicate, a family, a part of a text.  The newest of each group are cut
    once for all candidates, and a candidate takes the groups that it asks for.
    """
    n = max(30, 3 * top)
    low = lambda x: F.lower(F.col(x))
    given = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    some = lambda entries: F.explode(F.filter(F.array(*entries), lambda e: e["a"].isNotNull() & e["b"].isNotNull()))
    group = lambda name, a, b: [F.lit(name).alias("group"), a.alias("a"), b.alias("b")]
    none, families = F.lit(""), ("task", "preference")
    family = lambda kind: F.when(F.col("memory_type") == kind, F.get_json_object("scope", f"$.{kind}_family_key"))
    newest = F.when(F.col("memory_type") == "task", none)
    # The groups of a memory; a list of n takes from no group more than its n newest.
    held = [F.struct(*group(*g)) for g in [("key", F.col("memory_key"), none), ("predicate", low("predicate"), none), ("key and predicate", F.col("memory_key"), low("predicate")), *[("family", family(k), none) for k in families], ("newest", newest, none)]]
    groups = memories.select("memory_type", "id", "updated_at", some(held).alias("g")).select("memory_type", "id", "updated_at", "g.*")
    # Parts of texts: only what some candidate asks for is looked up.
    c = candidates.select("candidate_id", "memory_type", "memory_key", "predicate", "object_value", "entities", "scope")
    value = F.when(given("object_value"), F.lower(F.substring("object_value", 1, 120)))
    values = c.where(value.isNotNull()).select("candidate_id", "memory_type", "memory_key", value.alias("needle"))
    names = F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 5)
    named = c.where(F.size(names) > 0).select("candidate_id", "memory_type", "memory_key", F.explode(names).alias("name")).where("name IS NOT NULL").select("candidate_id", "memory_type", "memory_key", F.lower(F.substring("name", 1, 120)).alias("needle"))
    parts = []
    for name, needles, hay in (("value", values, low("object_value")), ("name", named, F.lower(F.coalesce("content", none)))):
        found = _containing(needles.select("memory_type", "needle"), memories.where(hay.isNotNull()).select("memory_type", "id", "updated_at", "memory_key", hay.alias("hay")))
        keyed = found.join(needles.select("memory_type", "needle", "memory_key").distinct(), ["memory_type", "needle", "memory_key"])
        columns = ["memory_type", "id", "updated_at"]
        parts += [found.select(*columns, *group(name, F.col("needle"), none)), keyed.select(*columns, *group(f"key and {name}", F.col("memory_key"), F.col("needle")))]
    for part in parts:
        groups = groups.unionByName(part)
    first = Window.partitionBy("memory_type", "group", "a", "b").orderBy(F.desc("updated_at"), F.desc("id"))
    groups = groups.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("rank")
    # The groups of a candidate, each with the list that it belongs to and the lead that its rows have there.
    entry = lambda i, name, length, lead, *g: F.struct(F.lit(i).alias("list"), F.lit(name).alias("channel"), F.lit(length).alias("length"), F.lit(lead).alias("lead"), *group(*g))
    generic = (F.col("memory_type") == "preference") & (T.normalize_content(F.col("predicate")) == "preference")
    slot = F.when(given("predicate") & ~generic, low("predicate"))
    asks = [
        entry(0, "exact", 20, 0, "key", F.col("memory_key"), none), entry(1, "structured", n, 0, "predicate", slot, none), entry(1, "structured", n, 1, "key and predicate", F.col("memory_key"), slot),
        *[entry(2, "family", min(20, n), 0, "family", family(k), none) for k in families], entry(3, "structured", n, 0, "newest", newest, none),
    ]
    asked = c.select("candidate_id", "memory_type", some(asks).alias("g")).select("candidate_id", "memory_type", "g.*")
    for name, needles in (("value", values), ("name", named)):
        more = [entry(1, "structured", n, 0, name, F.col("needle"), none), entry(1, "structured", n, 1, f"key and {name}", F.col("memory_key"), F.col("needle"))]
        asked = asked.unionByName(needles.select("candidate_id", "memory_type", some(more).alias("g")).select("candidate_id", "memory_type", "g.*"))
    taken = asked.join(groups, ["memory_type", "group", "a", "b"]).groupBy("candidate_id", "list", "channel", "length", "id", "updated_at").agg(F.max("lead").alias("lead"))
    place = Window.partitionBy("candidate_id", "list").orderBy(F.desc("lead"), F.desc("updated_at"), F.desc("id"))
    listed = taken.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= F.col("length")).select("candidate_id", "id", "channel", "rank")
    scored = with_bonuses(fuse([listed], MEMORY_CHANNELS, "candidate_id"), memories, candidates, "candidate_id").join(memories.select("id", "updated_at"), "id")
    best = Window.partitionBy("candidate_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= min(top, 50)).select("candidate_id", "id", "score", "channels", "rank")
