"""Features of a question and the route that they suggest, as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.rules import any_of

# Markers of what a question asks for, of references, of one scope and of vague wording.
COMPARISON = ("比较", "对比", "区别", "差异", "compare", "contrast", "difference")
CAUSAL = ("为什么", "原因", "因为什么", "为何", "why", "because", "cause", "reason")
TREND = ("变化", "趋势", "演变", "前后", "历史", "演进", "change", "trend", "evolution", "over time")
RELATION = ("关联", "关系", "之间", "影响", "相关性", "relationship", "related", "impact")
SUMMARY = ("总结", "归纳", "概括", "汇总", "总结一下", "summary", "summarize", "overall")
REFERENCE = ("那个", "这个", "那件事", "这件事", "它", "之前说的", "上次", "前面提到", "the one", "that thing", "it", "previous")
VAGUE = ("怎么样", "怎么了", "有进展吗", "做到哪", "换得", "进展如何", "how is", "what happened")
ONE_SCOPE = ("只查询", "只查找", "唯一当前", "单独查询", "only", "just look up", "exactly one")
STEPS = r"(?i)(?:先|首先).*(?:再|然后|接着).*(?:最后|再给出|并给出)|step\s*by\s*step|first.*then.*finally"
NOT_ASKED = "(?:不要|无需|不需要|不必|不用|无须|别|don't|do not|without)"
CLAUSES = r"(?:并且|同时|另外|还有|以及|然后|最后|此外|；|;|。|\n|[?？])"
INTENTS = {
    "task_status": ("任务", "待办", "进度", "完成", "做到哪", "task", "todo", "status"), "preference": ("喜欢", "偏好", "习惯", "讨厌", "preference"), "note_history": ("笔记", "记录", "历史", "note", "history"),
}
SCOPES = {"current": ("现在", "当前", "目前", "today", "current"), "recent": ("最近", "近期", "这几天", "recent", "lately"), "history": ("之前", "历史", "上个月", "过去", "before", "history")}
MANY_CHARACTERS = 50


def asked(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a marker occurs that no negation stands shortly before."""
    either = "|".join(re.escape(m) for m in sorted(markers, key=len, reverse=True))
    return text.rlike(rf"(?i)(?<!{NOT_ASKED}[^，,。；;？?]{{0,8}})(?:{either})")


def question_clauses(text: Column) -> Column:
    """The distinct clauses of a question, of two characters or more."""
    ends = "[ ，,。！？?!]+"
    parts = F.transform(F.split(text, CLAUSES), lambda p: T.squeeze(F.regexp_replace(p, f"^{ends}|{ends}$", "")))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2))


def refers_back(text: Column) -> Column:
    """Whether a question refers to something said before."""
    found = F.when(F.contains(text, F.lit("其它")), text.rlike("(?<!其)它")).otherwise(F.contains(text, F.lit("它")))
    words = [m for m in REFERENCE if m.isascii()]
    return found | any_of(text, tuple(m for m in REFERENCE if not m.isascii() and m != "它")) | F.lower(text).rlike(r"\b(?:" + "|".join(words) + r")\b")


def _named(tests: dict[str, Column], none: str | None = None) -> Column:
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return found if none is None else F.when(F.size(found) == 0, F.array(F.lit(none))).otherwise(found)


def route(question: Column) -> Column:
    """A struct of complexity (simple, complex, uncertain), confidence, strategies, reasons, language,
    clauses, intents and time_scopes of a question."""
    text = T.squeeze(question)
    low = F.lower(text)
    clauses = question_clauses(text)
    flags = {"comparison": asked(text, COMPARISON), "causal": asked(text, CAUSAL), "trend": asked(text, TREND), "relation": asked(text, RELATION), "summary": asked(text, SUMMARY)}
    steps, back, step_back = text.rlike(STEPS) | (F.size(clauses) >= 2), refers_back(text), low.rlike("step[- ]back")
    is_complex = reduce(lambda a, b: a | b, [*flags.values(), steps, step_back])
    either = "|".join(re.escape(m) for m in COMPARISON + CAUSAL + SUMMARY)
    negated = text.rlike(rf"(?i){NOT_ASKED}\s*(?:再\s*)?(?:{either})")
    why = flags["causal"] | flags["trend"]
    wide = flags["relation"] | flags["summary"]
    strategies = F.array_distinct(F.filter(F.array(
        F.when(step_back, "step_back"), F.when(flags["comparison"] | steps, "decomposition"), F.when(why, "step_back"), F.when(wide, "decomposition"), F.when(back, "rewrite"),
    ), lambda x: x.isNotNull()))
    reasons = _named({
        "explicit_step_back": step_back, "comparison_or_difference": flags["comparison"], "multiple_question_clauses": steps, "causal_or_temporal_analysis": why, "relationship_analysis": flags["relation"],
        "evidence_aggregation": flags["summary"], "unresolved_reference": back,
    })
    one = lambda *x: F.array(*[F.lit(v) for v in x])
    decide = lambda kind, confidence, how, reason: F.struct(F.lit(kind).alias("complexity"), F.lit(confidence).alias("confidence"), how.alias("strategies"), reason.alias("reasons"))
    decision = (
        F.when(text == "", decide("simple", 1.0, one("none"), one("empty_query"))).when(is_complex, decide("complex", 0.96, strategies, reasons)).when(negated & ~back, decide("simple", 0.93, one("none"), one("negated_complex_operations")))
        .when(any_of(low, ONE_SCOPE), decide("simple", 0.93, one("none"), one("explicit_single_scope"))).when(F.length(text) > MANY_CHARACTERS, decide("uncertain", 0.58, one("rewrite"), one("long_or_mixed_query")))
        .when(back, decide("uncertain", 0.62, one("rewrite"), one("unresolved_reference"))).when(any_of(low, VAGUE), decide("uncertain", 0.64, one("rewrite"), one("ambiguous_status_wording")))
        .otherwise(decide("simple", 0.94, one("none"), one("single_clause_single_intent")))
    )
    cjk, latin = text.rlike("[\u3400-\u9fff]"), text.rlike("[A-Za-z]")
    language = F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("unknown")
    intents = {name: any_of(text, words) for name, words in INTENTS.items()} | {"relationship": flags["relation"], "summary": flags["summary"]}
    return F.struct(
        *[decision[c].alias(c) for c in ("complexity", "confidence", "strategies", "reasons")], language.alias("language"), clauses.alias("clauses"), _named(intents, "general_search").alias("intents"),
        _named({name: any_of(text, words) for name, words in SCOPES.items()}, "all").alias("time_scopes"),
    )
