"""Text functions as Columns: keys, tokens, clauses, overlaps, trigrams."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words removed from a normalised text, in order.
OWNER_WORDS = ("用户", "我现在", "我最近", "我", "本人", "目前", "现在", "最近")
# Question words and phrases taken out of what a question is about, the longest first.
QUERY_FILLERS = (
    "请优先回答", "请帮我查找", "请帮我查", "请查找", "请回答", "请问", "帮我", "告诉我",
    "结合长期记忆", "根据长期记忆", "长期记忆", "当前信息", "当前状态", "目前状态",
    "长期结论", "相关结论", "相关记忆", "最近记忆", "有什么记忆", "是什么状态",
    "是否已经完成", "是否完成", "需要处理吗", "需要处理", "偏好或习惯是什么", "偏好是什么",
    "习惯是什么", "分别", "比较", "对比", "总结", "归纳", "当前", "目前", "最近", "关于",
    "对应的", "对应", "里的", "是什么", "有哪些", "为什么", "怎么", "如何", "我的", "我对",
    "what is the current task status for", "what is my current memory about", "what is my preference about",
    "current task status", "current memory", "my preference", "what is", "about", "for",
)
# What else is taken out: the owner, words of intent, particles and marks.
TOPIC_PATTERNS = (r"(?:我|用户)(?:现在|当前|最近)?", r"(?:不喜欢|喜欢|讨厌|偏好|习惯|要做|待办|任务|进度|完成|取消)", r"[的了呢吗么嘛呀啊吧和与及、，,。；;：:！？?!()（）\[\]{}]")
# Words taken out of a search for notes and for provisional notes, in order.
NOTE_FILLERS = (
    "请问", "帮我", "告诉我", "查一下", "看一下", "什么", "哪个", "哪些",
    "是否", "有没有", "相关内容", "相关记录", "刚才", "上次",
)
# Patterns of names, of latin terms, of runs of characters and of clause ends.
NAME_PATTERN = r"[\u4e00-\u9fffA-Za-z]+-\d+|[A-Za-z][A-Za-z0-9+#._-]*|\d+(?:[._-]\d+)*"
TERM_PATTERN = r"[a-z0-9][a-z0-9+#._-]*"
CJK_PATTERN = r"[\u4e00-\u9fff]+"
WIDE_CJK_PATTERN = r"[\u3400-\u9fff]+"
CLAUSE_END = r"[。！？!?；;，,](?!(?:(?:嗯|呃)[，,]\s*)?(?:还在|还没|仍在|仍然))"
CONNECTORS = r"^(?:并且|而且|但是|不过|同时|然后|接着|另外|还|以及|，|,)\s*"
MAX_CLAUSES = 64


def casefold(text: Column) -> Column:
    """Lower case, with the one letter of the data that folds to two."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def normalize_content(text: Column) -> Column:
    """Letters and digits only, folded, without words that name the owner or the moment."""
    plain = F.regexp_replace(casefold(text), r"[^\p{L}\p{N}]+", "")
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), OWNER_WORDS, plain)


def least_length(text: Column) -> Column:
    """Letters and digits of a folded text, or of its beginning, that no word of the owner has: its normalised
    form, and that of any text that begins with it, is at least as long."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+|[" + "".join(sorted(set("".join(OWNER_WORDS)))) + "]", ""))


def topic_text(text: Column) -> Column:
    """What a question is about: fillers, owner, intent, particles and punctuation out, blanks squeezed."""
    out = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), sorted(QUERY_FILLERS, key=len, reverse=True), casefold(text))
    return squeeze(reduce(lambda c, p: F.regexp_replace(c, p, " "), TOPIC_PATTERNS, out))


def squeeze(text: Column) -> Column:
    """The words of a text with single blanks between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0\u3000]+", " "))


def named_tokens(text: Column) -> Column:
    """The distinct names, identifiers and numbers of a text, folded and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME_PATTERN), F.lit(0)), F.lower)))


def grams_of_runs(runs: Column, widths: tuple[int, ...]) -> Column:
    """Of every run in an array, its substrings of each width in turn, in order."""

    def of_width(run: Column, width: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - width + 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(width)))
        return F.filter(found, lambda g: F.length(g) == width)

    return F.flatten(F.transform(runs, lambda run: F.concat(*[of_width(run, w) for w in widths])))


def cjk_grams(text: Column, widths: tuple[int, ...] = (4, 3, 2)) -> Column:
    """The distinct substrings of the given widths of every run of CJK characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK_PATTERN), F.lit(0))
    return F.array_distinct(grams_of_runs(runs, widths))


def lexical_terms(text: Column) -> Column:
    """Search terms: latin runs, pairs of CJK characters and CJK characters that stand alone, fillers removed.

    Fillers and runs are all CJK; a text without such a character is only searched for latin runs.
    """

    def latin(value: Column) -> Column:
        return F.regexp_extract_all(value, F.lit(TERM_PATTERN), F.lit(0))

    def mixed(value: Column) -> Column:
        value = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), NOTE_FILLERS, value)
        runs = F.regexp_extract_all(value, F.lit(WIDE_CJK_PATTERN), F.lit(0))
        return F.concat(latin(value), F.filter(runs, lambda r: F.length(r) == 1), grams_of_runs(runs, (2,)))

    return F.array_distinct(let(casefold(text), lambda v: F.when(v.rlike(WIDE_CJK_PATTERN), mixed(v)).otherwise(latin(v))))


def char_set(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalize_content(text), "")), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlap_score(query: Column, content: Column) -> Column:
    """1 for equal keys, 0.82 to 1 if one contains the other, else the share of the query's names
    and character grams that the content has."""
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)

    def parts(t: Column) -> Column:
        found = {"key": normalize_content, "names": named_tokens, "grams": cjk_grams}
        return F.struct(*[f(t[side]).alias(f"{name}_{side}") for side in ("q", "c") for name, f in found.items()])

    def score(p: Column) -> Column:
        q, c = p["key_q"], p["key_c"]
        short, long = F.least(F.length(q), F.length(c)), F.greatest(F.length(q), F.length(c))
        inside = (short >= 2) & (F.contains(q, c) | F.contains(c, q))
        names, grams = share(p["names_q"], p["names_c"]), share(p["grams_q"], p["grams_c"])
        mixed = F.when((F.size(p["names_q"]) > 0) & (F.size(p["grams_q"]) > 0), 0.35 * names + 0.65 * grams).otherwise(F.when(F.size(p["names_q"]) > 0, names).otherwise(grams))
        return F.when((q == "") | (c == ""), 0.0).when(q == c, 1.0).when(inside, F.least(F.lit(1.0), 0.82 + 0.18 * short / long)).otherwise(F.round(mixed, 4))

    return let(F.struct(topic_text(query).alias("q"), topic_text(content).alias("c")), lambda t: let(parts(t), score))


def clauses(text: Column, most: int | None = MAX_CLAUSES) -> Column:
    """Clauses of a message: cut at ends, connectors dropped, of over 2 characters; the first `most`, or all."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE_END), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), CONNECTORS, "")))
    kept = F.filter(parts, lambda p: F.length(p) > 2)
    return kept if most is None else F.slice(kept, 1, most)


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of many words: one pattern, where a test for each would outgrow a compiled method."""
    return F.coalesce(text, F.lit("")).rlike("|".join(re.escape(w) for w in words))


def clause_spans(text: Column, most: int = MAX_CLAUSES) -> Column:
    """The clauses of `clauses` with their place: an array of index, text, start and end (from 0, before trimming)."""
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), CONNECTORS, ""))
    kind = "struct<kept:array<struct<index:int,text:string,start:int,end:int>>,pos:int>"

    def step(acc: Column, part: Column) -> Column:
        def with_text(c: Column) -> Column:
            found = F.array(F.struct(F.size(acc["kept"]).alias("index"), c.alias("text"), acc["pos"].alias("start"), (acc["pos"] + F.length(part)).alias("end")))
            return F.when((F.size(acc["kept"]) < most) & (F.length(c) > 2), F.concat(acc["kept"], found)).otherwise(acc["kept"])

        return F.struct(let(clean(part), with_text).alias("kept"), (acc["pos"] + F.length(part) + 1).alias("pos")).cast(kind)

    start = F.struct(F.array().alias("kept"), F.lit(0).alias("pos")).cast(kind)
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), CLAUSE_END), start, step)["kept"]


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text, each word with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def clip(text: Column, n: int) -> Column:
    """A text of at most `n` characters, with dots where it was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def fact_key(*parts: Column) -> Column:
    """Parts joined by colons, the last as 16 hex digits of its SHA-256."""
    *head, last = parts
    return F.concat_ws(":", *head, F.substring(F.sha2(last.cast("binary"), 256), 1, 16))


def iso_period(ts: Column, cadence: str) -> Column:
    """The key of the day, ISO week or month of a moment."""
    if cadence == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if cadence == "month":
        return F.date_format(ts, "yyyy-MM")
    if cadence == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    raise ValueError(f"unknown cadence: {cadence}")


def safe_name(text: Column) -> Column:
    """A name that is safe in a path."""
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("default")), r"[^A-Za-z0-9_.-]+", "_")
