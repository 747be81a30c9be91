"""Search terms of a query, identifiers, and full-text match and rank, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as T

# Runs that become terms, and identifiers such as TASK-123.
MEMORY_RUN_PATTERN = r"[A-Za-z0-9][A-Za-z0-9+#._-]*|[一-鿿]+"
NOTE_RUN_PATTERN = r"[a-z0-9][a-z0-9+#._-]*|[㐀-鿿]+"
IDENTIFIER_PATTERN = r"[一-鿿A-Za-z]+-\d+|[A-Za-z][A-Za-z0-9+#._-]*-\d+"
#: Most terms of a query for memories and for notes, most identifiers, and most words of a full-text query.
MEMORY_TERMS, NOTE_TERMS, IDENTIFIERS = 12, 18, 4


def _terms(values: Column, most: int) -> Column:
    """The first distinct values of two characters or more, trimmed."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) >= 2)), 1, most)


def memory_terms(text: Column, entities: Column | None = None) -> Column:
    """Terms of a query for memories: of its topic, of itself and of given entities the words, the
    runs and the substrings of CJK runs, then its key; the first twelve."""
    none = F.array().cast("array<string>")

    def of(value: Column) -> Column:
        words = F.split(T.squeeze(F.replace(F.replace(value, F.lit("："), F.lit(" ")), F.lit(":"), F.lit(" "))), " ")
        runs = F.regexp_extract_all(value, F.lit(MEMORY_RUN_PATTERN), F.lit(0))
        return F.concat(words, T.let(runs, lambda found: F.concat(found, T.grams_of_runs(F.filter(found, lambda r: r.rlike(r"^[一-鿿]+$")), (4, 3, 2)))))

    def built(t: Column) -> Column:
        parts = [F.when((t["topic"] != "") & (t["topic"] != t["text"]), of(t["topic"])).otherwise(none), of(t["text"])]
        if entities is not None:
            parts.append(F.flatten(F.transform(F.coalesce(entities, none), of)))
        return _terms(F.concat(*parts, F.array(T.normalize_content(t["text"]))), MEMORY_TERMS)

    return T.let(F.struct(T.topic_text(text).alias("topic"), F.coalesce(text, F.lit("")).alias("text")), built)


def note_terms(text: Column) -> Column:
    """Terms of a query for notes: each run and, of CJK runs, the substrings, then the whole without
    blanks; fillers removed; the first eighteen."""
    value = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), T.NOTE_FILLERS, T.casefold(T.squeeze(text)))
    runs = F.regexp_extract_all(value, F.lit(NOTE_RUN_PATTERN), F.lit(0))
    each = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.when(r.rlike(r"^[㐀-鿿]+$"), T.grams_of_runs(F.array(r), (4, 3, 2))).otherwise(F.array().cast("array<string>")))))
    return _terms(F.concat(each, F.array(F.regexp_replace(value, r"\s+", ""))), NOTE_TERMS)


def identifiers(text: Column) -> Column:
    """The first four identifiers of a query."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER_PATTERN), F.lit(0)), 1, IDENTIFIERS)


def has_identifier(text: Column, wanted: Column) -> Column:
    """Whether a text has one of the identifiers, not as part of a longer word, case ignored."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def apart(identifier: Column) -> Column:
        parts = F.split(low, F.concat(F.lit("\\Q"), F.lower(identifier), F.lit("\\E")))
        ends = r"[\p{L}\p{N}]$"
        pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: ~a.rlike(ends) & ~b.rlike(r"^[\p{L}\p{N}]"))
        return F.exists(pairs, lambda p: p)

    # Only a text with the identifier in it is divided there.
    return F.exists(wanted, lambda identifier: F.contains(low, F.lower(identifier)) & apart(identifier))


def like_any(text: Column, terms: Column, width: int) -> Column:
    """Whether a text contains one of the terms, cut to a width, case ignored; % and _ stand for themselves."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(terms, lambda t: F.contains(low, F.lower(F.substring(t, 1, width))))


def lexemes(text: Column) -> Column:
    """The words of a document or of a plain full-text query, folded, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain_match(words: Column, query_words: Column) -> Column:
    """Whether a document has every word of a plain query; false for a query without words."""
    return (F.size(query_words) > 0) & F.forall(query_words, lambda w: F.array_contains(words, w))


# Fixed value: what a word counts that has no weight of its own.
PLAIN_WEIGHT = 0.1


def rank_cover(words: Column, query_words: Column) -> Column:
    """The cover-density rank of a document (its words in order) for distinct words of a query.

    A cover is a shortest run of the document with every word of the query: no shorter run within it has
    them all.  Each adds a weight divided by one more than the other words inside it, so words that stand
    together count more than words far apart.  Rounded to nine places; 0 where a word is lacking, for empty texts and for queries
    without words.  One pass over the places of the query's words; of it only the last place of each word
    and the sum so far are kept.
    """
    places = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(query_words, w).cast("int").alias("term"), i.alias("at"))), lambda p: p["term"] > 0)
    numbered = F.transform(places, lambda p, n: F.struct(p["term"].alias("term"), p["at"].alias("at"), n.alias("n")))
    unseen = F.transform(query_words, lambda w: F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("n")))
    start = F.struct(unseen.alias("last"), F.lit(-1).alias("opened"), F.lit(0.0).alias("rank"))

    def step(state: Column, p: Column) -> Column:
        last = F.transform(state["last"], lambda seen, i: F.when(i + 1 == p["term"], F.struct(p["at"].alias("at"), p["n"].alias("n"))).otherwise(seen))

        def closed(k: Column) -> Column:
            # The run that ends here begins at the word seen longest ago; one that ended before may have begun there too.
            begin = F.array_min(k)
            others = (p["at"] - begin["at"]) - (p["n"] - begin["n"])
            is_cover = (begin["at"] >= 0) & (begin["at"] > state["opened"])
            return F.struct(
                k.alias("last"), F.when(is_cover, begin["at"]).otherwise(state["opened"]).alias("opened"),
                (state["rank"] + F.when(is_cover, F.lit(PLAIN_WEIGHT) / (F.lit(1) + others)).otherwise(F.lit(0.0))).alias("rank"),
            )

        return F.element_at(F.transform(F.array(last), closed), 1)

    return F.when(F.size(query_words) > 0, F.aggregate(numbered, start, step, lambda s: F.round(s["rank"], 9))).otherwise(F.lit(0.0))


def spaced(text: Column, lowered: bool = False) -> Column:
    """The words of `lexemes` as one text, a blank before and after each: words are found in it without an array."""
    low = text if lowered else F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def spaced_match(words: Column, query_words: Column) -> Column:
    """`plain_match` of a text of `spaced`."""
    return (F.size(query_words) > 0) & F.forall(query_words, lambda w: F.contains(words, F.concat(F.lit(" "), w, F.lit(" "))))


def spaced_rank(words: Column, query_words: Column) -> Column:
    """`rank_cover` of a text of `spaced` for distinct words of `lexemes`.

    The text is cut before each word of the query, so only those are gone through; the others are counted.
    """
    pieces = F.split(words, F.concat(F.lit(" (?=(?:"), F.array_join(query_words, "|"), F.lit(") )")))
    unseen = F.transform(query_words, lambda w: F.struct(F.lit(-1).alias("n"), F.lit(0).alias("others")))
    # n: the query's words so far; others: the other words so far.
    start = F.struct(unseen.alias("last"), F.lit(-1).alias("opened"), F.lit(0.0).alias("rank"), F.lit(0).alias("n"), F.lit(0).alias("others"))

    def step(state: Column, piece: Column) -> Column:
        here = F.struct(state["n"].alias("n"), state["others"].alias("others"))
        term = F.array_position(query_words, F.substring_index(piece, " ", 1)).cast("int")
        last = F.transform(state["last"], lambda seen, i: F.when(i + 1 == term, here).otherwise(seen))

        def closed(k: Column) -> Column:
            begin = F.array_min(k)
            is_cover = (begin["n"] >= 0) & (begin["n"] > state["opened"])
            return F.struct(
                k.alias("last"), F.when(is_cover, begin["n"]).otherwise(state["opened"]).alias("opened"),
                (state["rank"] + F.when(is_cover, F.lit(PLAIN_WEIGHT) / (F.lit(1) + state["others"] - begin["others"])).otherwise(F.lit(0.0))).alias("rank"),
                (state["n"] + 1).alias("n"), (state["others"] + F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))).alias("others"),
            )

        return F.element_at(F.transform(F.array(last), closed), 1)

    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces) - 1), start, step, lambda s: F.round(s["rank"], 9))
    return F.when(F.size(query_words) > 0, found).otherwise(F.lit(0.0))


def web_query(query: str) -> list[dict[str, list]]:
    """A web search string as alternatives (OR); each has phrases to have, in order, and to lack.

    Quotes make a phrase, a minus before a word or phrase excludes it, `or` divides alternatives.
    """
    import re

    found: list[dict[str, list]] = [{"have": [], "lack": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not phrase and word.lower() == "or" and not minus:
            found.append({"have": [], "lack": []})
            continue
        words = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if words:
            found[-1]["lack" if minus else "have"].append(words)
    return [f for f in found if f["have"] or f["lack"]]


def web_match(words: Column, query: str) -> Column:
    """Whether a document (its words in order) matches a web search string."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    has = lambda phrase: F.contains(text, F.lit(" " + " ".join(phrase) + " "))
    some = F.lit(False)
    for part in web_query(query):
        every = F.lit(True)
        for phrase in part["have"]:
            every = every & has(phrase)
        for phrase in part["lack"]:
            every = every & ~has(phrase)
        some = some | every
    return some
