"""Valence, mood and episodicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom import config as C


def valence(text: Column) -> Column:
    """Signed magnitude in [-1, 1]: net lexicon hits over the root of the words that count. Null stays null."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: (t != "") & ~t.isin(C.NEUTRAL_WORDS))

    def scored(n: Column) -> Column:
        value = n["net"] / F.sqrt(n["size"])
        faint = (n["size"] < C.LEAST_TOKENS) | (F.abs(value) < C.SIGN_THRESHOLD)
        return F.when(faint, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))

    def counted(w: Column) -> Column:
        net = F.aggregate(w, F.lit(0), lambda n, t: n + F.when(t.isin(C.POSITIVE_WORDS), 1).when(t.isin(C.NEGATIVE_WORDS), -1).otherwise(0))
        return F.struct(net.alias("net"), F.size(w).alias("size"))

    # Lambdas name the words and their counts, so that a text is split once.
    counts = F.transform(F.array(words), counted)
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(F.element_at(F.transform(counts, scored), 1))


def mood_valence(mood: Column) -> Column:
    """Valence of a mood of the closed list; null for any other."""
    pairs = [F.lit(x) for pair in C.MOODS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(mood)))


def episodicity(anchored: Column, corroborations: Column, generality: Column, strength: Column) -> Column:
    w = C.EPISODIC
    x = w["base"] + w["anchor"] * anchored + w["corroboration"] * F.log1p(corroborations) + w["generality"] * generality + w["valence"] * strength
    return 1 / (1 + F.exp(-x))


def episodicity_match(fact: Column, query: Column) -> Column:
    """1 less the distance; one half where either is missing."""
    return F.coalesce(1 - F.abs(fact - query), F.lit(0.5))


def valence_match(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.abs(a - b) / 2))
