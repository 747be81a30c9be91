"""Adjudication of candidates against what is known, and the rows of change that decisions bring.

`candidates` are canonical candidates (`extraction.canonical`) with space, at (order), should_store and,
if known, observed_at; `memories` have id, space, status, updated_at, current_version, importance,
confidence and the same descriptive columns.  Columns in FIELDS that a frame lacks count as null.

Pairs come from equality joins only: by key, by content, by goals and topics (one inside the other met
by an anchor of up to ANCHOR characters), by signatures that share all but few of their pairs of
characters.  No join lets all candidates of a space meet all its memories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import identity, preference, rules
from brindle.functions import text as T
from brindle.operators import evolution, lifecycle

FIELDS = (
    "memory_type", "memory_key", "content", "evidence_span", "subject", "predicate", "object_value", "task_status", "polarity", "scope", "operation", "topic", "family_key", "old_value", "new_value",
    "blocker", "progress_note", "closure_reason", "observed_at", "importance", "confidence",
)
# Markers by which a task goes on, an error is corrected, a claim is unsure, and a text adds detail.
GOING_ON = ("还需要", "仍需", "继续", "尚未", "未完成", "待完善", "没做完", "接下来要")
CORRECTIONS = ("不准确", "错误记录", "说错", "更正", "实际是", "正确的是")
UNCONFIRMED = ("另一条", "未确认", "没有说明", "据说", "听说")
DETAILS = ("并补充", "补充了", "详细", "详情", "会后记录", "负责人", "截止", "长期状态", "工作时", "工作日", "早上", "下午", "晚上")
TIME_CHANGES, NEGATED, LIVING = ("改为", "改成", "时间"), "没有", ("搬到", "住在")
# Actions that change a memory, and the confidence they need; confidences of decisions.
DESTRUCTIVE, SURE = ("merge", "update", "update_task", "supersede", "conflict"), 0.75
NEW, SAME, PAIRED = 0.8, 0.92, 0.82
# The scores of two records by what they share, from equal keys down, and the weights of the rest.
EQUAL_KEYS, EQUAL_TEXTS, EQUAL_FAMILY, ONE_INSTANCE, TASK_FAMILY, NEAR_TOPICS, REFINED = 1.0, 0.98, 0.84, 0.90, 0.75, 0.68, 0.66
MIN_SIMILARITY, MOST_NEIGHBOURS, NEWEST_EVENTS = 0.18, 8, 8
ANCHOR = 8
#: Columns that state what a task is about.
GOALS = ("predicate", "topic", "object_value")
#: Columns that are compared without case, marks and owners.
NORMALISED = ("content", "subject", "predicate", "object_value", "scope", "operation", "topic", "old_value", "new_value", "blocker", "progress_note", "closure_reason")


def described(frame: DataFrame) -> DataFrame:
    """`frame` with what comparisons need of FIELDS, kept until it is unpersisted.

    Only what takes a while to work out is kept.  Columns that the frame lacks, and all that would follow
    from them alone, are left out: `_side` states them as the constants that they are.
    """
    given = set(frame.columns)
    liked, task = F.col("memory_type") == "preference", F.col("memory_type") == "task"
    nothing = F.array().cast("array<string>")
    text = F.coalesce("content", F.lit(""))
    own = lambda *names: [F.col(c) if c in given else F.lit(None).cast("string") for c in names]
    known = {f"n_{c}": T.normalize_content(F.coalesce(c, F.lit(""))) for c in NORMALISED if c in given}
    said = preference.signature(text, own("object_value")[0] if "object_value" in given else None)
    known["sig"] = F.when(liked, T.let(said, lambda s: F.struct(*[s[x].alias(x) for x in ("key", "polarity", "scopes", "names")])))
    if goals := [c for c in GOALS if c in given]:
        known["goals"] = F.when(task, identity.family_topics(*own(*goals))).otherwise(nothing)
    known["marks"] = F.when(task, identity.instance_marks(text, *own("predicate", "object_value")))
    known["codes"] = F.when(task, rules.task_identifiers(text)).otherwise(nothing)
    if "scope" in given:
        known["place"] = identity.scope_identity(F.coalesce("scope", F.lit("global")))
    if given & {"new_value", "object_value"}:
        new, value = own("new_value", "object_value")
        known["value"] = T.normalize_content(F.coalesce(F.nullif(new, F.lit("")), value, F.lit("")))
    return frame.withColumns(known).persist()


def _alike(candidates: DataFrame) -> list[str]:
    """The columns by which a candidate is judged: those of equal values in all of them are judged alike."""
    return [c for c in ("space", *FIELDS, "entities") if c in candidates.columns and c not in ("importance", "confidence")]


def _with_key(frame: DataFrame, columns: list[str]) -> DataFrame:
    """`frame` with those columns as one, alike, where nulls equal nulls, and its hash, by which it is sorted faster."""
    return frame.withColumn("alike", F.struct(*columns)).withColumn("hash", F.xxhash64("alike"))


def _side(frame: DataFrame, prefix: str = "") -> dict[str, Column]:
    """The columns of a described frame, whose names begin with `prefix` where it is read, and those that it lacks."""
    given = {c: F.col(prefix + c) for c in frame.columns}
    lit, nothing = F.lit(""), F.array().cast("array<string>")
    rest = {c: F.lit(None).cast("double" if c in ("importance", "confidence") else "string") for c in FIELDS}
    rest |= {f"n_{c}": lit for c in NORMALISED} | {"goals": nothing, "entities": nothing, "place": F.lit("global"), "value": lit}
    x = rest | given
    text = F.coalesce(x["content"], lit)
    return x | {"said": F.concat_ws(" ", F.coalesce(x["evidence_span"], lit), text), "names": F.array_sort(F.coalesce(x["sig"]["names"], nothing)), "compares": T.mentions(text, preference.COMPARATIVE_MARKERS)}


def _letters(key: Column) -> Column:
    return F.filter(F.array_distinct(F.split(key, "")), lambda c: c != "")


def _shared_letters(a: Column, b: Column) -> Column:
    return T.let(F.struct(_letters(a).alias("a"), _letters(b).alias("b")), lambda p: T.jaccard(p["a"], p["b"]))


def _same(c: dict[str, Column], m: dict[str, Column], name: str) -> Column:
    return (F.coalesce(c[name], F.lit("")) != "") & (F.coalesce(m[name], F.lit("")) != "") & (c[f"n_{name}"] == m[f"n_{name}"])


def is_one_instance(c: dict[str, Column], m: dict[str, Column]) -> Column:
    """Whether a candidate may change a task: one scope, the same rounds and codes, and an equal key, a
    shared goal, a related goal with another state, or a title that narrows the known one."""
    refined = F.exists(c["goals"], lambda a: F.exists(m["goals"], lambda b: (F.length(b) >= 2) & (F.length(a) > F.length(b)) & F.endswith(a, b)))
    related = (F.coalesce(c["family_key"], F.lit("")) != "") & (c["family_key"] == m["family_key"]) | identity.topics_meet(c["goals"], m["goals"])
    changed = ~c["task_status"].eqNullSafe(m["task_status"])
    met = F.arrays_overlap(c["goals"], m["goals"]) | (changed & F.coalesce(related, F.lit(False))) | ((c["n_subject"] == m["n_subject"]) & refined)
    return (c["memory_type"] == "task") & (m["memory_type"] == "task") & (c["place"] == m["place"]) & ((c["memory_key"] == m["memory_key"]) | ((c["marks"] == m["marks"]) & met))


def guard(c: dict[str, Column], m: dict[str, Column]) -> dict[str, Column]:
    """The facts about a candidate and a memory, described, that the relation guard decides by."""
    yes = lambda test: F.coalesce(test, F.lit(False))
    differs = lambda name: c[f"n_{name}"] != m[f"n_{name}"]
    changed = lambda name: (c[f"n_{name}"] != "") & differs(name)
    progress = changed("progress_note") & ~F.contains(c["n_content"], c["n_progress_note"])
    reopened = T.mentions(c["said"], lifecycle.REOPENING + GOING_ON)
    return {
        "same_type": yes(c["memory_type"] == m["memory_type"]), "memory_type": c["memory_type"], "same_key": yes(c["memory_key"] == m["memory_key"]),
        "stale": evolution.is_stale(c["observed_at"], F.coalesce(F.nullif(m["observed_at"], F.lit("")), m["updated_text"])), "instance": yes(is_one_instance(c, m)), "values_changed": changed("old_value") | changed("new_value"),
        "old_status": m["task_status"], "new_status": c["task_status"], "closure_differs": F.coalesce(c["closure_reason"], F.lit("")) != F.coalesce(m["closure_reason"], F.lit("")), "metadata_changed": progress | differs("blocker") | differs("closure_reason"),
        "detail": differs("content") & T.mentions(c["said"], DETAILS), "terminal_reactivation": yes((m["task_status"] == "done") & (c["task_status"] == "todo")) & ~reopened,
        "same_scope": F.coalesce(F.nullif(c["n_scope"], F.lit("")), F.lit("global")) == F.coalesce(F.nullif(m["n_scope"], F.lit("")), F.lit("global")), "correction": T.mentions(c["said"], CORRECTIONS),
        "unconfirmed": T.mentions(c["said"], UNCONFIRMED) | yes((c["memory_type"] == "preference") & preference.is_alternative(c["content"], c["sig"], m["sig"])),
        "old_polarity": F.coalesce(m["polarity"], c["polarity"], F.lit("")), "new_polarity": F.coalesce(c["polarity"], m["polarity"], F.lit("")), "same_subject": _same(c, m, "subject"), "same_predicate": _same(c, m, "predicate"),
        "same_value": (c["value"] != "") & (c["value"] == m["value"]), "time_change": T.mentions(c["content"], TIME_CHANGES), "negative_claim": F.contains(F.coalesce(c["content"], F.lit("")), F.lit(NEGATED)),
    }


def shares(c: dict[str, Column], m: dict[str, Column]) -> dict[str, Column]:
    """What the similarity of two described rows is made of, each worked out only where it is asked for."""
    kind = lambda name: (c["memory_type"] == name) & (m["memory_type"] == name)
    given = lambda name: (F.coalesce(c[name], F.lit("")) != "") & (F.coalesce(m[name], F.lit("")) != "")
    yes = lambda test: F.coalesce(test, F.lit(False))
    title = lambda x: F.coalesce(F.nullif(x["n_predicate"], F.lit("")), F.nullif(x["n_topic"], F.lit("")), x["n_content"])
    refined = _same(c, m, "subject") & (c["n_operation"] == m["n_operation"]) & (c["place"] == m["place"]) & (F.length(m["n_predicate"]) >= 2) & (F.length(c["n_predicate"]) > F.length(m["n_predicate"])) & F.endswith(c["n_predicate"], m["n_predicate"])
    entity = F.exists(c["entities"], lambda e: (e != "") & F.contains(F.lower(m["content"]), F.lower(e)))
    topic = lambda x: F.coalesce(x["sig"]["key"], F.lit(""))
    return {
        "content": _shared_letters(c["n_content"], m["n_content"]), "object": F.when(given("object_value"), _shared_letters(c["n_object_value"], m["n_object_value"])).otherwise(0.0), "title": F.when(kind("task"), _shared_letters(title(c), title(m))).otherwise(0.0),
        "topic": F.when(kind("preference"), _shared_letters(topic(c), topic(m))).otherwise(0.0), "predicate": yes(given("predicate") & (c["predicate"] == m["predicate"])), "subject": _same(c, m, "subject"), "entity": yes(entity),
        "family": yes((F.coalesce(c["family_key"], F.lit("")) != "") & (c["family_key"] == m["family_key"])), "instance": yes(is_one_instance(c, m)), "goal": yes(kind("task") & (c["place"] == m["place"]) & identity.topics_meet(c["goals"], m["goals"])),
        "refined": yes(refined), "codes": yes(kind("task") & (c["place"] == m["place"]) & ((F.size(c["codes"]) == 0) | (F.size(m["codes"]) == 0) | (c["codes"] == m["codes"]))),
        "on_topic": yes(kind("preference") & ((preference.compatibility(c["sig"], m["sig"]) >= preference.COMPATIBLE) | preference.is_alternative(c["content"], c["sig"], m["sig"]))),
        "slot": yes(_same(c, m, "subject") & _same(c, m, "predicate") & ~c["predicate"].isin("fact", "事实")), "moved": yes(T.mentions(c["content"], LIVING) & T.mentions(m["content"], LIVING)),
    }


def similarity(c: dict[str, Column], m: dict[str, Column]) -> Column:
    """How near a candidate is to a memory: fixed scores for shared keys, texts, families and goals, else a
    weighted sum of shared characters, predicate, subject, object and names.  Most pairs that matter share
    their key, and nothing else is worked out for those."""
    s, kind = shares(c, m), c["memory_type"]
    broad = 0.58 * s["title"] + 0.24 * s["content"] + F.when(s["subject"], 0.18).otherwise(0.0)
    broad = F.when(s["codes"], T.let(broad, lambda x: F.when(x >= 0.28, F.round(F.least(x, F.lit(0.60)), 4)).otherwise(0.0))).otherwise(0.0)
    task = F.when(s["instance"], ONE_INSTANCE).when(s["family"], TASK_FAMILY).when(s["goal"], NEAR_TOPICS).when(s["refined"], REFINED).otherwise(broad)
    near = T.let(s["topic"], lambda t: F.when(t >= 0.22, F.round(F.least(F.lit(0.78), 0.45 + t * 0.33), 4)).otherwise(0.0))
    taste = F.when((F.size(c["names"]) > 0) | (F.size(m["names"]) > 0), F.when(c["names"] == m["names"], 0.82).otherwise(0.0))
    taste = taste.when(~preference.scopes_meet(c["sig"]["scopes"], m["sig"]["scopes"]), 0.0).otherwise(near)
    mixed = 0.55 * s["content"] + F.when(s["predicate"], 0.35).otherwise(0.0) + F.when(s["subject"], 0.30).otherwise(0.0) + 0.20 * s["object"] + F.when(s["entity"], 0.25).otherwise(0.0)
    mixed = F.round(F.least(F.lit(1.0), F.greatest(mixed, F.when(s["moved"], 0.72).otherwise(0.0))), 4)
    other = (
        F.when(kind != m["memory_type"], 0.0).when(kind == "task", task).when((kind == "preference") & s["family"], EQUAL_FAMILY).when((kind == "preference") & ~s["on_topic"], taste)
        .when((kind == "semantic") & ~s["slot"], 0.0).otherwise(mixed)
    )
    return F.when(c["memory_key"] == m["memory_key"], EQUAL_KEYS).when(c["n_content"] == m["n_content"], EQUAL_TEXTS).otherwise(other)


def _inside(needles: DataFrame, hay: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a needle that lies inside a hay, from (`by`, needle_id, needle) and (`by`, hay_id, hay).

    Equal texts are looked up once.  Texts meet on the needle's first ANCHOR characters and on the hay's
    substrings of up to that length, of which only those are made that begin as some needle does.
    """
    needles, hay = needles.where(F.length("needle") >= 2), hay.where(F.length("hay") >= 2)
    n = needles.select(*by, "needle").distinct().withColumn("anchor", F.substring("needle", 1, ANCHOR))
    h = hay.select(*by, "hay").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.length("hay") - 1))).withColumn("head", F.substr("hay", F.col("i"), F.lit(2)))
    h = h.join(n.select(*by, F.substring("needle", 1, 2).alias("head")).distinct(), [*by, "head"], "left_semi")
    widths = F.sequence(F.lit(2), F.least(F.lit(ANCHOR), F.length("hay") - F.col("i") + 1))
    h = h.withColumn("width", F.explode(widths)).select(*by, "hay", F.substr("hay", F.col("i"), F.col("width")).alias("anchor"))
    met = n.join(h, [*by, "anchor"]).where(F.contains("hay", F.col("needle"))).select(*by, "needle", "hay").distinct()
    return met.join(needles, [*by, "needle"]).join(hay, [*by, "hay"]).select("needle_id", "hay_id")


def neighbours(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs (candidate_id, id) of a candidate and a memory, both described, of its space and type that may bear on each other."""
    columns = ["space", "memory_type", "memory_key", "n_content", "sig"]
    has = lambda name: name in candidates.columns and name in memories.columns
    more = [x for x in ("goals", "family_key") if has(x)]
    of = _side(candidates)
    c = candidates.select("candidate_id", *columns, *more, *[of[x].alias(x) for x in ("names", "said", "compares")])
    m = memories.select("id", *columns, *more, _side(memories)["names"].alias("names"))
    met = [c.join(m.select("id", *by), by).select("candidate_id", "id") for by in (["space", "memory_type", "memory_key"], ["space", "memory_type", "n_content"])]
    inside = lambda left, right, key: met.extend([
        _inside(key(right, "id", "needle"), key(left, "candidate_id", "hay"), ["space"]).select(F.col("hay_id").alias("candidate_id"), F.col("needle_id").alias("id")),
        _inside(key(left, "candidate_id", "needle"), key(right, "id", "hay"), ["space"]).select(F.col("needle_id").alias("candidate_id"), F.col("hay_id").alias("id")),
    ])
    # Tasks: a goal inside another, in either direction; a family.
    if has("goals"):
        inside(c, m, lambda frame, key, name: frame.where("memory_type = 'task'").select("space", F.col(key).alias(f"{name}_id"), F.explode("goals").alias(name)))
    if has("family_key"):
        newest = Window.partitionBy("space", "family_key").orderBy(F.desc("updated_at"), F.desc("id"))
        recent = memories.where("family_key <> ''").select("id", "space", "family_key", "updated_at").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= MOST_NEIGHBOURS).select("id", "space", "family_key")
        met.append(c.join(recent, ["space", "family_key"]).select("candidate_id", "id"))
    # Preferences: topics inside each other, the same names, nearly the same pairs of characters, alternatives of one kind.
    cp, mp = c.where("memory_type = 'preference' AND sig.key <> ''"), m.where("memory_type = 'preference' AND sig.key <> ''")
    inside(cp, mp, lambda frame, key, name: frame.select("space", F.col(key).alias(f"{name}_id"), F.col("sig.key").alias(name)))
    names = lambda frame: frame.where(F.size("names") > 0)
    met.append(names(cp).join(names(mp).select("space", "names", "id"), ["space", "names"]).select("candidate_id", "id"))
    tail = lambda frame: frame.where(F.length("sig.key") >= 2).withColumn("tail", F.expr("right(sig.key, 2)"))
    met.append(tail(cp).where("compares").join(tail(mp).select("space", "tail", "id"), ["space", "tail"]).select("candidate_id", "id"))
    # Corrections of events: the newest events of the space.
    latest = Window.partitionBy("space").orderBy(F.desc("updated_at"), F.desc("id"))
    events = memories.where("memory_type = 'episodic'").select("id", "space", "updated_at").withColumn("n", F.row_number().over(latest)).where(F.col("n") <= NEWEST_EVENTS).select("id", "space")
    met.append(c.where("memory_type = 'episodic'").where(T.mentions(F.col("said"), CORRECTIONS)).join(events, "space").select("candidate_id", "id"))
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    # What is dealt by candidate stays so for the next join.
    return out.repartition("candidate_id").distinct()


def compared(candidates: DataFrame, memories: DataFrame, pairs: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """`pairs` (candidate_id, id) with their similarity, and the columns of their candidate and memory, both described."""
    named = lambda frame, key, prefix: frame.select(key, *[F.col(x).alias(prefix + x) for x in frame.columns])
    c, m = _side(candidates, "c_"), _side(memories, "m_")
    m["updated_text"] = F.date_format(m["updated_at"], "yyyy-MM-dd'T'HH:mm:ss")
    met = pairs.join(named(candidates, "candidate_id", "c_"), "candidate_id").join(named(memories, "id", "m_"), "id")
    return met.withColumn("similarity", similarity(c, m)), c, m


def _counts(c: dict[str, Column], m: dict[str, Column]) -> Column:
    """Whether a candidate is judged against a memory at all: a fact only by its key or text."""
    equal = (c["memory_key"] == m["memory_key"]) | (c["n_content"] == m["n_content"])
    return F.coalesce(F.when(c["memory_type"] == "semantic", equal).otherwise(F.col("similarity") >= MIN_SIMILARITY), F.lit(False))


def _nearest(pairs: DataFrame, top: int) -> DataFrame:
    """Of pairs with counts, fact, similarity and updated_at, the first of a fact and the `top` others of a candidate, with their rank.

    Those that do not count come last and go after the ranks: a filter before them would be worked out with
    the pairs, and so would all that it reads, once more.
    """
    best = Window.partitionBy("candidate_id").orderBy(F.desc("counts"), F.desc("similarity"), F.desc("updated_at"), F.desc("id"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("counts") & (F.col("rank") <= F.when(F.col("fact"), 1).otherwise(max(1, min(top, 20)))))


def retrieve(candidates: DataFrame, memories: DataFrame, pairs: DataFrame, top: int = MOST_NEIGHBOURS) -> DataFrame:
    """The memories that each candidate (both described) is judged against: candidate_id, id, similarity, rank.

    `pairs` (candidate_id, id) may come from any search.  A fact is only judged against one with its
    key or its text; others need a similarity of MIN_SIMILARITY.
    """
    found, c, m = compared(candidates, memories, pairs)
    fact = F.coalesce(c["memory_type"] == "semantic", F.lit(False))
    found = found.select("candidate_id", "id", "similarity", _counts(c, m).alias("counts"), fact.alias("fact"), m["updated_at"].alias("updated_at"))
    return _nearest(found, top).select("candidate_id", "id", "similarity", "rank")


def adjudicate(candidates: DataFrame, memories: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """A decision for every candidate: candidate_id, relation, action, reason, confidence, target_id,
    snapshot_version, n_targets.

    `retrieved` (candidate_id, id) is what each is judged against; without it, what `neighbours` finds
    among active memories and `retrieve` would take of that; then candidates that differ in confidence alone
    are searched for and judged once, and each pair is read once, for its similarity and its judgement.  By
    the first rule that holds: what is not to be stored is discarded; without neighbours it is new; a fact is
    new unless its key is known; several memories with the key need a review; a compared alternative or a
    preference with the other polarity of its family is a conflict; the one with the key is judged by the
    relation guard; without one, a task or event that the guard lets change a memory changes it.  Changes
    below SURE need a review.
    """
    searched, told = retrieved is None, candidates
    should = F.coalesce(F.col("should_store"), F.lit(True)) if "should_store" in candidates.columns else F.lit(True)
    if searched:
        columns = _alike(candidates)
        candidates = _with_key(candidates.where(should), columns).select("hash", "alike").distinct().select(F.unhex(F.md5(F.to_json("alike").cast("binary"))).alias("candidate_id"), "alike.*")
    candidates, active = described(candidates), described(memories.where("status = 'active'"))
    pairs, c, m = compared(candidates, active, neighbours(candidates, active) if searched else retrieved.select("candidate_id", "id"))
    yes = lambda test: F.coalesce(test, F.lit(False))
    meet = preference.scopes_meet(c["sig"]["scopes"], m["sig"]["scopes"])
    liked = c["memory_type"] == "preference"
    alternative = liked & c["compares"] & meet & preference.is_alternative(c["content"], c["sig"], m["sig"])
    against = liked & (c["family_key"] == m["family_key"]) & (F.coalesce(c["polarity"], F.lit("")) != "") & (c["polarity"] != m["polarity"]) & meet & (preference.compatibility(c["sig"], m["sig"]) >= preference.COMPATIBLE)
    pairs = pairs.withColumn("counts", _counts(c, m) if searched else F.lit(True))
    facts = {"exact": yes(c["memory_key"] == m["memory_key"]), "g": evolution.relation(guard(c, m)), "alternative": yes(alternative), "against": yes(against), "family": yes(liked & (c["family_key"] == m["family_key"]))}
    # What is not judged is not worked out.
    judged = F.when(F.col("counts"), F.struct(*[x.alias(name) for name, x in facts.items()]))
    pairs = pairs.select("candidate_id", "id", "similarity", "counts", yes(c["memory_type"] == "semantic").alias("fact"), m["updated_at"].alias("updated_at"), m["current_version"].alias("version"), judged.alias("f"))
    if searched:
        pairs = _nearest(pairs, MOST_NEIGHBOURS)
    pairs = pairs.select("candidate_id", "id", "similarity", "updated_at", "version", "f.*")
    changes = F.col("g.approved") & F.col("g.action").isin("update_task", "update")
    row = F.struct("id", "version", "g", "similarity")
    newest, nearest = F.struct("updated_at", "version", "id"), F.struct("similarity", "updated_at", "version", "id")
    best = lambda test, order: F.max_by(F.when(test, row), F.when(test, order))
    seen = pairs.groupBy("candidate_id").agg(
        F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact") & changes).alias("n_changes"), best(F.col("exact"), newest).alias("known"), best(F.col("alternative"), newest).alias("rival"),
        F.max("against").alias("against"), best(F.col("family"), newest).alias("kin"), best(~F.col("exact") & changes, nearest).alias("near"),
    )
    rows = told.select("candidate_id", "memory_type", "confidence", should.alias("should_store"), *([F.struct(*columns).alias("alike")] if searched else []))
    if searched:
        seen = _with_key(candidates.select("candidate_id", *columns), columns).select("candidate_id", "hash", "alike").join(seen, "candidate_id").drop("candidate_id")
        rows = rows.withColumn("hash", F.xxhash64("alike")).join(seen, ["hash", "alike"], "left")
    else:
        rows = rows.join(seen, "candidate_id", "left")
    sure, kind = F.coalesce("confidence", F.lit(0.0)), F.col("memory_type")
    combined = lambda relation: lifecycle.combined_confidence(sure, relation)
    at_least = lambda x: F.greatest(sure, F.lit(x))

    def ruled(relation, action, reason, confidence, target=None, n=None) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        none = F.lit(None)
        return F.struct(
            text(relation).alias("relation"), text(action).alias("action"), text(reason).alias("reason"), confidence.cast("double").alias("confidence"),
            (none.cast(id_type) if target is None else target["id"]).alias("target_id"), (none.cast("int") if target is None else target["version"].cast("int")).alias("snapshot_version"), (F.lit(0 if target is None else 1) if n is None else n).cast("int").alias("n_targets"),
        )

    id_type = memories.schema["id"].dataType
    known, near, rival, kin = F.col("known"), F.col("near"), F.col("rival"), F.col("kin")
    guarded = F.when(known["g"]["action"] == "update_task", combined(F.greatest(F.lit(PAIRED), known["similarity"]))).when(known["g"]["action"].isin("update", "supersede", "pending_review"), combined(F.greatest(F.lit(NEW), known["similarity"])))
    guarded = guarded.when(known["g"]["action"] == "add_source", at_least(SAME)).otherwise(at_least(NEW))
    decision = (
        F.when(~F.col("should_store"), ruled("new", "discard", "candidate_should_not_store", sure)).when(F.col("n_exact").isNull(), ruled("new", "insert", "no_related_active_memory", at_least(NEW)))
        .when((kind == "semantic") & (F.col("n_exact") > 0), ruled("same", "add_source", "same_semantic_fact", at_least(SAME), known)).when(kind == "semantic", ruled("new", "insert", "semantic_append_only", at_least(NEW)))
        .when(F.col("n_exact") > 1, ruled("ambiguous_match", "pending_review", "multiple_exact_identity_matches", at_least(NEW), known, F.col("n_exact")))
        .when(rival.isNotNull(), ruled("conflict", "pending_review", "ambiguous_preference_conflict", combined(F.lit(PAIRED)), rival))
        .when(F.col("n_exact") == 1, ruled(known["g"]["relation"], known["g"]["action"], known["g"]["reason"], guarded, known))
        .when((kind == "preference") & F.col("against"), ruled("conflict", "pending_review", "preference_family_polarity_conflict", at_least(PAIRED), kin))
        .when((kind == "task") & (F.col("n_changes") > 1), ruled("ambiguous_match", "pending_review", "multiple_task_instance_matches", at_least(NEW), near, F.col("n_changes")))
        .when(F.col("n_changes") == 0, ruled("new", "insert", "v3_no_exact_canonical_identity", at_least(NEW)))
        .otherwise(ruled(near["g"]["relation"], near["g"]["action"], near["g"]["reason"], combined(F.greatest(F.lit(PAIRED), near["similarity"])), near))
    )
    out = rows.select("candidate_id", decision.alias("d")).select("candidate_id", "d.*").withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")))
    weak = F.col("action").isin(*DESTRUCTIVE) & (F.col("confidence") < SURE)
    return out.withColumns({"reason": F.when(weak, F.concat("reason", F.lit("; below_auto_mutation_threshold"))).otherwise(F.col("reason")), "action": F.when(weak, "pending_review").otherwise(F.col("action"))})


def _confirmed(frames):
    """Confidence of each memory after its new sources, which come sorted; one number of state."""
    import pandas as pd

    memory, held = None, 0.0
    for frame in frames:
        done = []
        for m, start, given in zip(frame["memory_id"], frame["held"], frame["given"]):
            if m != memory:
                if memory is not None:
                    done.append((memory, held))
                memory, held = m, start
            held = min(0.99, max(held, held + (given - held) * 0.25 + 0.02))
        yield pd.DataFrame(done, columns=["memory_id", "confidence"])
    if memory is not None:
        yield pd.DataFrame([(memory, held)], columns=["memory_id", "confidence"])


def apply_decisions(decisions: DataFrame, candidates: DataFrame, memories: DataFrame, sources: DataFrame, applied: DataFrame) -> dict[str, DataFrame]:
    """The rows that decisions write: decisions, memories, versions, sources, relations.

    `candidates` has candidate_id, note_id, space, at, memory_type, memory_key, content, object_value,
    task_status, polarity, importance and confidence; `memories` id (text) and the same with
    current_version and status; `sources` memory_id, note_id and relation; `applied` candidate_id.

    A candidate decided before changes nothing, and of one given twice the first counts.  Decisions were
    made on a snapshot: of those that change one memory the first (by at, id) does, if the snapshot is
    the current version; a later one adds a source where it says what now holds, else it awaits a
    review.  The same holds of candidates that would insert one key.  No step gathers the decisions of
    one memory: firsts are minima, and confidences pass as a sorted stream.
    """
    fields = ["memory_type", "memory_key", "content", "object_value", "task_status", "polarity", "importance", "confidence"]
    fresh = candidates.groupBy("candidate_id").agg(F.min_by(F.struct("note_id", "space", "at", *fields), "at").alias("c")).select("candidate_id", "c.*").join(applied.select("candidate_id"), "candidate_id", "left_anti")
    told = decisions.select("candidate_id", "action", "relation", "reason", "target_id", "snapshot_version", F.col("confidence").alias("sure"))
    # A decision without a target meets nothing; a place of its own keeps those from going to one task.
    place = F.coalesce("target_id", F.concat(F.lit("\0"), F.col("candidate_id")))
    target = memories.select(F.col("id").alias("place"), F.struct("status", "current_version", *fields).alias("t"))
    rows = fresh.join(told, "candidate_id").withColumn("place", place).join(target, "place", "left").withColumn("t", F.when(F.col("target_id").isNotNull(), F.col("t")))
    missing = F.col("target_id").isNotNull() & F.col("t").isNull()
    rows = rows.withColumn("action", F.when(missing, F.raise_error(F.concat(F.lit("decision target memory not found: "), F.col("target_id"))).cast("string")).otherwise(F.col("action")))
    order, changing = F.struct("at", "candidate_id"), F.col("action").isin(*DESTRUCTIVE)
    current = F.coalesce(F.col("snapshot_version"), F.col("t.current_version")) == F.col("t.current_version")
    became = F.struct(F.when(F.col("action") == "update_task", F.col("task_status")).otherwise(F.col("t.task_status")).alias("task_status"), F.when(F.col("action").isin("supersede", "conflict"), F.col("t.object_value")).otherwise(F.coalesce("object_value", "t.object_value")).alias("object_value"), F.when(F.col("action").isin("supersede", "conflict"), F.col("t.memory_key")).otherwise(F.col("memory_key")).alias("memory_key"))
    firsts = rows.where(changing & current).groupBy("place").agg(F.min(order).alias("first"), F.min_by(became, order).alias("now"))
    own = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "space", "candidate_id").cast("binary"), 256), 1, 16))
    inserts = rows.where("action = 'insert'").groupBy("space", "memory_key").agg(F.min(order).alias("made"), F.min_by(F.struct(own.alias("id"), "task_status", "object_value", "memory_key", "confidence"), order).alias("new"))
    rows = rows.withColumn("order", order).withColumn("own_id", own).join(firsts, "place", "left").join(inserts, ["space", "memory_key"], "left")
    late = F.col("target_id").isNotNull() & F.when(F.col("first").isNotNull() & (F.col("order") > F.col("first")), True).otherwise(~current)
    twin = (F.col("action") == "insert") & (F.col("order") > F.col("made"))
    held = F.when(twin, F.struct("new.task_status", "new.object_value", "new.memory_key")).when(F.col("first").isNotNull() & (F.col("order") > F.col("first")), F.col("now")).otherwise(F.struct("t.task_status", "t.object_value", "t.memory_key"))
    rows = rows.withColumns({"late": F.coalesce(late, F.lit(False)), "twin": F.coalesce(twin, F.lit(False)), "held": held})
    task = F.col("memory_type") == "task"
    agrees = (F.col("memory_key") == F.col("held.memory_key")) & F.when(task, F.col("task_status").eqNullSafe(F.col("held.task_status"))).otherwise((F.coalesce("object_value", F.lit("")) != "") & (F.col("object_value") == F.col("held.object_value")))
    overtaken = F.col("late") | F.col("twin")
    agrees = F.coalesce(agrees, F.lit(False))
    rows = rows.withColumns(
        {
            "reason": F.when(overtaken & agrees, "concurrent_same_update_adds_source").when(overtaken, "stale_target_snapshot_requires_readjudication").otherwise(F.col("reason")),
            "relation": F.when(overtaken & agrees, "same").when(overtaken, "conflict").otherwise(F.col("relation")), "action": F.when(overtaken & agrees, "add_source").when(overtaken, "pending_review").otherwise(F.col("action")),
            "into": F.when(F.col("twin"), F.col("new.id")).otherwise(F.col("target_id")), "base": F.when(F.col("twin"), F.col("new.confidence")).otherwise(F.col("t.confidence")),
        }
    )
    act = F.col("action")
    updates, replaces = act.isin("merge", "update", "update_task"), act.isin("supersede", "conflict")
    adds = act.isin("insert", "pending_review") | replaces
    status = F.when(act == "pending_review", "pending_review").when(act == "conflict", "conflicted").otherwise("active")
    made = rows.where(adds).select(F.col("own_id").alias("memory_id"), "space", *fields, status.alias("status"), F.lit(1).alias("version"), "reason", "note_id")
    larger = lambda x, cap: F.least(F.lit(cap), F.greatest(F.col(f"t.{x}"), F.col(x)))
    content = F.when(act == "merge", lifecycle.merged_content(F.col("t.content"), F.col("content"))).when(updates, F.col("content")).otherwise(F.col("t.content"))
    keep = lambda x: F.when(updates, F.coalesce(F.col(x), F.col(f"t.{x}"))).otherwise(F.col(f"t.{x}")).alias(x)
    changed = rows.where(updates | replaces).select(
        F.col("target_id").alias("memory_id"), "space", "memory_type", keep("memory_key"), content.alias("content"), keep("object_value"), F.when(act == "update_task", F.col("task_status")).otherwise(F.col("t.task_status")).alias("task_status"), keep("polarity"),
        F.when(updates, larger("importance", 1.0)).otherwise(F.col("t.importance")).alias("importance"), F.when(updates, larger("confidence", 0.99)).otherwise(F.col("t.confidence")).alias("confidence"),
        F.when(act == "supersede", "superseded").when(act == "conflict", "conflicted").otherwise(F.col("t.status")).alias("status"), (F.col("t.current_version") + 1).cast("int").alias("version"), "reason", "note_id",
    )
    versions = made.unionByName(changed)
    kind = F.when(adds, "created_from").when(act.isin("update", "update_task"), "updated_by").otherwise("supported_by")
    cited = rows.where(adds | updates | (act == "add_source")).select(F.when(adds, F.col("own_id")).otherwise(F.col("into")).alias("memory_id"), "note_id", kind.alias("relation"), "order", F.col("confidence").alias("given"), F.col("base").alias("held"), (act == "add_source").alias("confirms"))
    cited = cited.unionByName(rows.where(replaces).select(F.col("target_id").alias("memory_id"), "note_id", F.lit("contradicted_by").alias("relation"), "order", F.col("confidence").alias("given"), F.col("base").alias("held"), F.lit(False).alias("confirms")))
    cited = cited.groupBy("memory_id", "note_id", "relation").agg(F.min_by(F.struct("order", "given", "held", "confirms"), "order").alias("s")).join(sources.select("memory_id", "note_id", "relation"), ["memory_id", "note_id", "relation"], "left_anti")
    confirming = cited.where("s.confirms").select("memory_id", "s.order", "s.held", "s.given")
    confirmed = confirming.repartition("memory_id").sortWithinPartitions("memory_id", "order").select("memory_id", F.col("held").cast("double"), F.col("given").cast("double")).mapInPandas(_confirmed, "memory_id string, confidence double")
    # A memory that this batch also changes keeps the larger of both confidences.
    latest = versions.withColumn("only_confirmed", F.lit(False)).select("memory_id", "only_confirmed", "version", "status", "content", "task_status", "object_value", "confidence", "importance")
    plain = memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("only_confirmed"), F.col("current_version").alias("version"), "status", "content", "task_status", "object_value", F.lit(None).cast("double").alias("confidence"), "importance")
    touched = latest.unionByName(plain.join(confirmed.select("memory_id"), "memory_id", "left_semi").join(latest.select("memory_id"), "memory_id", "left_anti")).join(confirmed.withColumnRenamed("confidence", "after"), "memory_id", "left")
    touched = touched.withColumn("confidence", F.greatest("confidence", "after")).drop("after", "only_confirmed")
    pair = lambda a, b, r: F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(r).alias("relation"))
    o, t = F.col("own_id"), F.col("target_id")
    both = F.when(act == "supersede", F.array(pair(o, t, "supersedes"), pair(t, o, "superseded_by"))).otherwise(F.array(pair(o, t, "conflicts_with"), pair(t, o, "conflicts_with")))
    result = F.when(replaces, F.array("own_id", "target_id")).when(adds, F.array("own_id")).when(act == "discard", F.array().cast("array<string>")).otherwise(F.array("into"))
    return {
        "decisions": rows.select("candidate_id", "action", "relation", "reason", F.when(act == "pending_review", "pending_review").otherwise("applied").alias("status"), result.alias("memory_ids"), "sure"),
        "memories": touched, "versions": versions.select("memory_id", "version", "status", "content", "task_status", "object_value", "confidence", "reason", "note_id"), "sources": cited.select("memory_id", "note_id", "relation"),
        "relations": rows.where(replaces).select(F.explode(both).alias("r")).select("r.*"),
    }
