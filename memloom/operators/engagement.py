"""How a turn takes up what was surfaced before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom import config as C


def words(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9_'-]`` without quotes and hyphens at their ends."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_'-]+"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, "^[-']+|[-']+$", "")), lambda t: t != "")


def runs(tokens: Column, k: int) -> Column:
    """All runs of k tokens, as text; none of a shorter list."""
    last = F.size(tokens) - k + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))


def engagement(turn: Column, user: Column, memory: Column) -> Column:
    """(class, weight) of a turn, with its words, towards a memory's words; null for a blank turn.

    In order: dismissal, correction (a denying word within six words of a word of the memory), a run of three
    words in common, three quarters of the memory's words in common. ``user`` and ``memory`` should be columns
    that were made by :func:`words` before, so that they are made once.
    """
    touches = F.arrays_overlap(user, memory)
    places = F.transform(user, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    denials = F.filter(places, lambda p: p["t"].isin(*C.NEGATIONS))
    start = lambda i: F.greatest(i - C.NEGATION_REACH, F.lit(0))
    around = lambda i: F.concat(F.slice(user, start(i) + 1, i - start(i)), F.slice(user, i + 2, F.lit(C.NEGATION_REACH)))
    corrects = F.exists(denials, lambda p: F.arrays_overlap(around(p["i"]), memory))
    follows = F.arrays_overlap(runs(user, C.ENGAGED_RUN), runs(memory, C.ENGAGED_RUN))
    bag = F.array_distinct(memory)
    share = F.try_divide(F.size(F.array_intersect(bag, user)), F.size(bag))
    name = (
        F.when(turn.rlike(C.DISMISSALS) & touches, "dismiss").when(corrects, "correction").when(follows, "direct").when(share >= C.ENGAGED_BAG, "paraphrase").otherwise("no_engagement")
    )
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in C.ENGAGEMENT.items() for x in kv]), name)
    return F.when(F.trim(turn) != "", F.struct(name.alias("class"), weight.alias("weight")))
