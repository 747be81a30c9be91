"""Identity keys, ids, names of spaces, contents of messages and texts to embed, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as T

# What a key of a preference and of a task leaves out of its topic.
PREFERENCE_WORDS = "(?:用户|本人|我现在|我最近|我|喜欢|更喜欢|最喜欢|偏好|习惯|不喜欢|讨厌|厌恶|不爱|不想|不打算|暂时不|过敏|优先选择|优先)"
PREFERENCE_VERBS = "^(?:喝|吃|用|使用|采用|选择|选|穿|看|听|玩|住|做|学习|学|买|去)"
TASK_WORDS = "(?:记得|需要|待办|完成|完善|处理|修复|修改|修|改|实现|已经|正在|进行中|开始|继续|阻塞|卡住|取消|不用做|不做了|现在|可以|还要给|补充测试|遇到)"
# Fixed value: the namespace of ids made from text.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _or(x: Column, y: Column | str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(y) if isinstance(y, str) else y)


def memory_key(memory_type: Column, subject: Column, predicate: Column, object_value: Column, content: Column) -> Column:
    """The key under which a memory is known: type, subject, slot and topic; a preference's key is the
    same for both polarities."""
    own = _or(T.normalize_content(_or(subject, "用户")), "用户")
    own = F.when(own.isin("user", "me", "myself"), "user").otherwise(own)
    slot = _or(T.normalize_content(_or(predicate, memory_type)), memory_type)
    value, whole = T.normalize_content(F.coalesce(object_value, F.lit(""))), T.normalize_content(content)
    liked = F.regexp_replace(F.regexp_replace(_or(value, whole), PREFERENCE_WORDS, ""), PREFERENCE_VERBS, "")
    done = F.regexp_replace(F.regexp_replace(F.regexp_replace(_or(value, whole), TASK_WORDS, ""), "^是+", ""), "了+$", "")
    fact = _or(_or(whole, value), F.substring(F.sha1(F.concat_ws("\x1f", own, slot, whole).cast("binary")), 1, 16))
    join = lambda *parts: F.concat_ws(":", *parts)
    return (
        F.when(memory_type == "preference", join(F.lit("preference"), own, _or(liked, "unspecified"), F.lit("global"))).when(memory_type == "task", join(F.lit("task"), own, slot, _or(done, "unspecified")))
        .when(memory_type == "semantic", join(F.lit("semantic"), own, slot, F.substring(fact, 1, 96))).otherwise(join(memory_type, own, slot, _or(value, whole)))
    )


def uuid5_hex(name: Column) -> Column:
    """The first 16 hex digits of the version 5 UUID of a text in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.coalesce(name, F.lit("")).cast("binary")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3))


def candidate_id(note_id: Column, memory_type: Column, content: Column) -> Column:
    return F.concat(F.lit("cand_"), uuid5_hex(F.concat_ws("\x1f", F.coalesce(note_id, F.lit("")), F.coalesce(memory_type, F.lit("")), T.normalize_content(content))))


def evidence_id(note_id: Column, clause: Column, memory_type: Column, key: Column, evidence: Column, content: Column) -> Column:
    """The id of a candidate by the clause and evidence that it rests on."""
    given = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("cand_"), uuid5_hex(F.concat_ws("\x1f", given(note_id), given(clause), given(memory_type), given(key), T.normalize_content(_or(evidence, content)))))


def space_id(chat_type: Column, chat_id: Column, sender: Column) -> Column:
    """The space of a chat: that of the sender in a private chat, else that of the chat; an error without either."""
    private, group = F.concat(F.lit("p_"), F.nullif(sender, F.lit(""))), F.concat(F.lit("g_"), F.nullif(chat_id, F.lit("")))
    found = F.when((chat_type == "p2p") & private.isNotNull(), private).otherwise(F.coalesce(group, private))
    return F.coalesce(found, F.raise_error(F.lit("a chat needs a chat id or a sender")).cast("string"))


def message_text(content: Column) -> Column:
    """The text of a message given as JSON; empty where it is none."""
    return F.coalesce(F.get_json_object(content, "$.text"), F.lit(""))


def without_mentions(text: Column, mentions: Column) -> Column:
    """A text without the keys of mentions and a mark of one at its start."""
    out = F.aggregate(F.filter(F.coalesce(mentions, F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != ""), text, lambda t, m: F.replace(t, m, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)^\s*<at\b[^>]*>.*?</at>\s*", ""), r"^\s+|\s+$", ""))


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，、]"), lambda t: F.trim(t)), lambda t: t != "")


def embedding_text(*parts: Column) -> Column:
    """What is embedded of a memory: type, subject, predicate, object and content."""
    return F.concat_ws(" | ", *[F.coalesce(p, F.lit("")) for p in parts])


def content_hash(text: Column, model: str, dimension: int, version: str) -> Column:
    """The hash by which a vector is known to be that of a text and a model."""
    return F.sha2(F.concat_ws("|", text, F.lit(model), F.lit(str(dimension)), F.lit(version)).cast("binary"), 256)
