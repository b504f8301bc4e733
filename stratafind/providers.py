"""Providers: what a language model, an embedder, a recogniser or a web service would give, as rules with fixed results.

A provider is an object whose methods take and give columns, so that its work stays in the plan; any of them can be replaced
by one with the same methods. `Rules` is used where none is named.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, functions as F

from .plans.agent import lead
from .functions.text import tokens

#: Relations a chunk gives at most, and pairs of names of the schema-free extraction.
TRIPLETS, PAIRS = 15, 5
#: Lists of up to this many triplets are not verified.
UNVERIFIED = 3
SENTENCE = r"[^.!?]+[.!?]"
TRIPLET = "([A-Z][a-z]+) ([a-z]+) ([a-z]+)"
PAIR = "([A-Z][a-z]+) ([A-Z][a-z]+)"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
# Waits in seconds before the tries of a rate-limited call.
WAITS = (0, 2, 4, 8)


class Model(Protocol):
    def sub_queries(self, query: Column) -> Column: ...
    def resolved(self, query: Column, history: Column) -> Column: ...
    def hypothetical(self, query: Column) -> Column: ...
    def category(self, text: Column) -> Column: ...
    def triplets(self, text: Column) -> Column: ...
    def pairs(self, text: Column) -> Column: ...
    def holds(self, triplet: Column) -> Column: ...
    def since(self, text: Column) -> Column: ...
    def answer(self, query: Column, context: Column) -> Column: ...
    def rewritten(self, text: Column) -> Column: ...


class Rules:
    def sub_queries(self, query: Column) -> Column:
        """Up to three parts of a compound question, the question itself if it has none."""
        parts = F.filter(F.transform(F.split(query, r" and |[;?]", -1), lambda p: F.trim(p)), lambda p: F.length(p) > 2)
        return F.when(F.size(parts) == 0, F.array(query)).otherwise(F.slice(parts, 1, 3))

    def resolved(self, query: Column, history: Column) -> Column:
        """Pronouns stand for the first name in the latest of the given turns that has one; newest first."""
        names = F.filter(F.transform(history, lambda h: F.regexp_extract(F.coalesce(h, F.lit("")), "[A-Z][a-z]+", 0)), lambda n: n != "")
        return F.when(F.size(names) == 0, query).otherwise(F.regexp_replace(query, F.lit(r"(?i)\b(it|they|this|that)\b"), F.get(names, 0)))

    def hypothetical(self, query: Column) -> Column:
        """The query and the words that an answer to it would hold."""
        return F.concat(query, F.lit("\n\nAn answer would mention: "), F.array_join(F.slice(F.regexp_extract_all(query, F.lit("[A-Za-z]{6,}"), F.lit(0)), 1, 5), ", "))

    def category(self, text: Column) -> Column:
        """snake_case of the first two longer words; general where there is none."""
        words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), 1, 2)
        return F.when(F.size(words) == 0, F.lit("general")).otherwise(F.array_join(words, "_"))

    def triplets(self, text: Column) -> Column:
        """array<struct(subject, relation, object)>: a name and the two words after it, TRIPLETS at most."""
        part = lambda k: F.regexp_extract_all(text, F.lit(TRIPLET), F.lit(k))
        made = F.zip_with(F.zip_with(part(1), part(2), lambda s, v: F.struct(s.alias("s"), v.alias("v"))), part(3), lambda a, o: F.struct(a["s"].alias("subject"), F.upper(a["v"]).alias("relation"), o.alias("object")))
        return F.slice(made, 1, TRIPLETS)

    def pairs(self, text: Column) -> Column:
        """array<struct(subject, relation, object)> without a schema: names side by side, PAIRS at most."""
        part = lambda k: F.regexp_extract_all(text, F.lit(PAIR), F.lit(k))
        return F.slice(F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("subject"), F.lit("RELATED_TO").alias("relation"), b.alias("object"))), 1, PAIRS)

    def holds(self, triplet: Column) -> Column:
        """Whether a triplet says something: its object is more than two letters."""
        return F.length(triplet["object"]) > 2

    def since(self, text: Column) -> Column:
        """The first year in a text, null without one."""
        return F.nullif(F.regexp_extract(text, YEAR, 0), F.lit(""))

    def answer(self, query: Column, context: Column) -> Column:
        """Extractive: the context's first two sentences."""
        return F.concat(F.lit("Based on the context:"), lead(context))

    def rewritten(self, text: Column) -> Column:
        """Contractions written out."""
        for short, long in CONTRACTIONS:
            text = F.replace(text, F.lit(short), F.lit(long))
        return text


CONTRACTIONS = (("it's", "it is"), ("don't", "do not"), ("they're", "they are"), ("can't", "cannot"))


def in_windows(text: Column, rewrite, size: int = 4000) -> Column:
    """A provider's rewrite of a text, window by window."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), rewrite), "")


def verified(triplets: Column, model: Model) -> Column:
    """Of more than UNVERIFIED triplets those that the provider confirms, in their order; fewer are taken as they are."""
    return F.when(F.size(triplets) > UNVERIFIED, F.filter(triplets, model.holds)).otherwise(triplets)


def overlap(part: Column, whole: Column) -> Column:
    """Share of the part's distinct tokens that the whole has; 0 for none."""
    mine = F.array_distinct(tokens(part))
    return F.when(F.size(mine) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(mine, tokens(whole))) / F.size(mine), 6))


def retried(failures: Column) -> Column:
    """struct(waited, succeeded) of a call whose first `failures` tries meet a rate limit; it gives up after the last wait."""
    tries = F.least(failures + F.lit(1), F.lit(len(WAITS)))
    waited = F.aggregate(F.slice(F.array(*map(F.lit, WAITS)), F.lit(1), tries), F.lit(0), lambda a, x: a + x)
    return F.struct(waited.alias("waited"), (failures < F.lit(len(WAITS))).alias("succeeded"))
