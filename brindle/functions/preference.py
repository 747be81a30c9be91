"""Preferences as Columns: what they are about, their scopes and qualifiers, and whether two may be one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.rules import NEGATIVE_MARKERS, POSITIVE_MARKERS, polarity

# What stands before and around the object of a preference.
OWNER_START, CHANGE_START = "^(?:用户|本人|我)+", "^(?:现在|以后|目前|最近|从现在起|已经|改为|改成)+"
LIGHT_VERBS, PARTICLES_END = "^(?:吃|喝|用|使用|采用|选择|选|穿|看|听|玩|住|做|学习|学|买|去)+", "(?:了|啦|呢|吧|呀|啊)+$"
COORDINATION_START, CONTRAST_END = r"^(?:和|及|以及|与|跟|还有)(?=\S)", "(?:而不是|而非|胜过|多于).*$"
NEGATED_VERB = "(?:暂时|目前|现在)?不(?:再)?(?=(?:吃|喝|用|使用|采用|选择|选|穿|看|听|玩|住|做|学习|学|买|去))"
PARTS, ALLERGY, ALLERGEN = r"[，,；;。\n]|(?:但是|不过|同时|而且)", "过敏", "(?:对)?([^，,。；;]{1,30})$"
# Scopes, in order, and the pattern of others.
SCOPES = ("早上", "上午", "中午", "下午", "晚上", "夜里", "工作时", "学习时", "开会时", "周末", "工作日", "在家", "在公司", "在办公室")
ANY_SCOPE, SCOPE_START = "(?:在|当)([^，,。；;]{1,16}?)(?:时|的时候)", "^(?:在|当)[^，,。；;]{1,16}?(?:时|的时候)"
# Modifiers that may precede the object, in the order in which they are tried; objects with a name of their own.
MODIFIERS = {
    "无糖": "sugar_free", "低糖": "low_sugar", "少糖": "low_sugar", "太甜的": "sweet", "很甜的": "sweet", "浓郁的": "strong", "浓的": "strong", "浓": "strong", "清淡的": "light", "淡的": "light", "淡": "light",
}
NAMED_TOPICS = {"太甜": "sweetness", "太甜的饮料": "甜味饮料", "甜的饮料": "甜味饮料"}
# Families of preferences by the words of their topics, in order.
FAMILIES = {
    "口味": ("甜", "咸", "辣", "酸", "苦", "口味", "味道", "甜度", "清淡", "sweetness", "sweet"),
    "饮品": ("咖啡", "茶", "水", "饮料", "拿铁", "可乐", "果汁", "气泡", "酒", "啤酒", "奶", "大窑"),
    "设备": ("电脑", "手机", "键盘", "鼠标", "macbook", "iphone", "耳机", "设备"),
    "工作方式": ("工作", "会议", "沟通", "远程", "办公", "日程", "效率"),
    "内容": ("电影", "音乐", "书", "阅读", "游戏", "播客", "视频"),
    "饮食": ("苹果", "米饭", "面", "菜", "食物", "零食", "餐"),
}
NO_FAMILY, DRINKS = "其他", ("饮料", "饮品")
# Markers of a comparison, and of a change.
COMPARATIVE_MARKERS = ("更喜欢", "更偏好", "相比", "相较", "宁愿", "而不是", "而非")
CHANGE_MARKERS = ("现在", "以后", "改为", "改成", "不再", "从现在起", "目前", "最近")
NAMED = r"[A-Za-z][A-Za-z0-9+#._-]*|\d+(?:[._-]\d+)*"
TOPIC_LENGTH, MOST_SCOPES, MOST_PARTS = 160, 6, 4
# How far two topics are one: equal, same names, one inside the other, shared pairs of characters.
SAME_NAMES, INSIDE, PAIRS = 0.94, 0.88, 0.78
INSIDE_SHARE, PAIRS_SHARE, COMPATIBLE = 0.55, 0.58, 0.75

_MARKER = "(" + "|".join([*sorted(NEGATIVE_MARKERS + POSITIVE_MARKERS, key=len, reverse=True), NEGATED_VERB]) + ")"
#: The listed scopes, longest first, each once, at the start.
_SCOPES_START = "^" + "".join(f"(?:{s}[，,：: ]*)?+" for s in sorted(SCOPES, key=len, reverse=True))
_MODIFIER = "|".join(f"{m}(?=.)" for m in MODIFIERS)


def strip(text: Column, marks: str = r"\s") -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def _object(text: Column) -> Column:
    """What follows the earliest marker (the longest of those that start there); what precedes an allergy."""
    marker, at = F.regexp_extract(text, _MARKER, 1), F.regexp_instr(text, F.lit(_MARKER))
    before = F.substr(text, F.lit(1), at - 1)
    return F.when(at == 0, text).when(marker == ALLERGY, F.coalesce(F.nullif(F.regexp_extract(before, ALLERGEN, 1), F.lit("")), before)).otherwise(F.substr(text, at + F.length(marker)))


def _without_scope(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, _SCOPES_START, ""), SCOPE_START, ""), "，,：: ")


def topic(text: Column) -> Column:
    """A struct of topic and qualifiers: what a preference is about, and what it adds to that."""
    value = strip(F.regexp_replace(strip(F.regexp_replace(T.squeeze(text), OWNER_START, "")), CHANGE_START, ""))

    def cleaned(p: Column) -> Column:
        main = _without_scope(F.get(p["parts"], F.lit(0)))
        main = F.regexp_replace(strip(F.regexp_replace(main, CHANGE_START, "")), LIGHT_VERBS, "")
        main = strip(F.regexp_replace(strip(main, " ：:，,。；;"), "^(?:对|对于)", ""))
        main = strip(F.regexp_replace(strip(F.regexp_replace(main, COORDINATION_START, "")), CONTRAST_END, ""))
        return F.struct(strip(F.regexp_replace(main, PARTICLES_END, "")).alias("main"), F.slice(p["parts"], 2, MOST_PARTS).alias("more"))

    def named(p: Column) -> Column:
        run = F.regexp_extract(p["main"], rf"^((?:(?:{_MODIFIER})\s*)*+)", 1)
        bare = F.substr(p["main"], F.length(run) + 1)
        said = F.transform(F.regexp_extract_all(run, F.lit("(" + "|".join(MODIFIERS) + ")"), F.lit(1)), lambda m: _mapped(m, MODIFIERS))
        return F.struct(F.substring(_mapped(bare, NAMED_TOPICS), 1, TOPIC_LENGTH).alias("topic"), F.array_distinct(F.concat(p["more"], said)).alias("qualifiers"))

    def split(rest: Column) -> Column:
        parts = F.filter(F.transform(F.split(rest, PARTS), lambda p: strip(p)), lambda p: p != "")
        return F.struct(F.when(F.size(parts) > 0, parts).otherwise(F.array(rest)).alias("parts"))

    return T.let(value, lambda v: T.let(_object(v), lambda rest: T.let(split(rest), lambda p: T.let(cleaned(p), named))))


def _mapped(value: Column, names: dict[str, str]) -> Column:
    found = value
    for name, to in names.items():
        found = F.when(value == name, F.lit(to)).otherwise(found)
    return found


def scopes(text: Column) -> Column:
    """When or where a preference holds: the listed scopes that a text has, then others that it states."""
    fixed = F.filter(F.array(*[F.lit(s) for s in SCOPES]), lambda s: F.contains(text, s))
    other = F.filter(F.transform(F.regexp_extract_all(text, F.lit(ANY_SCOPE), F.lit(1)), T.normalize_content), lambda s: s != "")
    return F.slice(F.array_distinct(F.concat(fixed, other)), 1, MOST_SCOPES)


def signature(text: Column, hint: Column | None = None) -> Column:
    """A struct of topic, key (the topic normalised), polarity, scopes, qualifiers and names; where the
    text has no topic, that of the hint."""
    text = F.coalesce(text, F.lit(""))

    def built(t: Column) -> Column:
        own = t["topic"] if hint is None else F.when((t["topic"] == "") & (F.trim(F.coalesce(hint, F.lit(""))) != ""), topic(hint)["topic"]).otherwise(t["topic"])
        names = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(NAMED), F.lit(0)), F.lower))
        return T.let(own, lambda o: F.struct(o.alias("topic"), T.normalize_content(o).alias("key"), polarity(text).alias("polarity"), scopes(text).alias("scopes"), t["qualifiers"].alias("qualifiers"), names(o).alias("names")))

    return T.let(topic(text), built)


def family(topic_text: Column, source: Column) -> Column:
    """The broad family of a topic: the first whose words it has; a plain drink of some taste is a taste."""

    def of(k: Column) -> Column:
        found = F.lit(NO_FAMILY)
        for name, words in reversed(list(FAMILIES.items())):
            found = F.when(T.mentions(k["key"], words), F.lit(name)).otherwise(found)
        return F.when(k["key"].isin(*DRINKS) & T.mentions(k["said"], FAMILIES["口味"]), F.lit("口味")).otherwise(found)

    return T.let(F.struct(T.normalize_content(topic_text).alias("key"), T.normalize_content(source).alias("said")), of)


def _pairs(key: Column) -> Column:
    return F.when(F.length(key) < 2, F.filter(F.array(key), lambda k: k != "")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(2)))))


def compatibility(left: Column, right: Column) -> Column:
    """How far two signatures are about one thing: 1, 0.94, 0.88, 0.78 of their shared pairs, or 0."""
    a, b = left["key"], right["key"]
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    share = T.jaccard(_pairs(a), _pairs(b))
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
        .when((F.size(left["names"]) > 0) | (F.size(right["names"]) > 0), F.when(F.array_sort(left["names"]) == F.array_sort(right["names"]), SAME_NAMES).otherwise(0.0))
        .when((F.length(short) >= 2) & F.contains(long, short) & (F.length(short) / F.length(long) >= INSIDE_SHARE), INSIDE).when(share >= PAIRS_SHARE, F.round(PAIRS * share, 4)).otherwise(0.0)
    )


def scopes_meet(left: Column, right: Column) -> Column:
    """Whether two lists of scopes share one, or one of them is empty."""
    return (F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(left, right)


def is_alternative(new: Column, new_signature: Column, old_signature: Column) -> Column:
    """Whether a text compares its object with another of the same kind: both liked, with a common end."""
    a, b = F.reverse(new_signature["key"]), F.reverse(old_signature["key"])
    short = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), n + 1).otherwise(n))
    both = (new_signature["polarity"] == "positive") & (old_signature["polarity"] == "positive") & (a != "") & (b != "") & (a != b)
    return T.mentions(F.coalesce(new, F.lit("")), COMPARATIVE_MARKERS) & both & T.let(same, lambda n: (n >= 2) & (n / short >= 0.4))


def replaces(new: Column, old: Column) -> Column:
    """Whether a preference takes the place of another: the opposite polarity, or a marker of change."""
    a, b = polarity(new), polarity(old)
    return ((a != "unknown") & (b != "unknown") & (a != b)) | T.mentions(F.coalesce(new, F.lit("")), CHANGE_MARKERS)
