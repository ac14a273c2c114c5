"""Entities, time anchors, chunks and prefixes out of text, inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose decomposition starts with an ASCII letter, by rule.
_MARKED = [(c, d) for c, d in ((chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250)) if d.isascii() and c != d]

# Shapes of entities by kind.
ENTITY_SHAPES = (
    ("url", "https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("phone", "[+][0-9][0-9 ()-]{7,}[0-9]"),
    ("topic", "#[A-Za-z][A-Za-z0-9_-]{2,}"),
)
ENTITIES_MAX = 32

# Names of months, and days in the units of spans.
MONTHS = "january february march april may june july august september october november december".split()
UNIT_DAYS = {"day": 1, "week": 7}
ANCHOR_SHAPE = "|".join(
    [
        "[0-9]{4}-[0-9]{2}-[0-9]{2}",
        f"(?:{'|'.join(MONTHS)}) [0-9]{{1,2}}, [0-9]{{4}}",
        "(?:in [0-9]{1,3} (?:day|week)s?)",
        "(?:[0-9]{1,3} (?:day|week)s? ago)",
        "today|yesterday|tomorrow",
    ]
)


def slug(surface: Column) -> Column:
    """Lower-case ASCII with marks stripped, other runs as one underscore, at most 64 long."""
    plain = F.translate(surface, "".join(c for c, _ in _MARKED), "".join(d for _, d in _MARKED))
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 64)


def _kind(text: Column, source: Column, kind: str, shape: str) -> Column:
    surfaces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({shape})"), F.lit(1))
    return F.transform(surfaces, lambda x: F.concat(F.lit(f"{kind}:"), source, F.lit(":"), slug(x)))


def entities(text: Column, source: Column, most: int = ENTITIES_MAX) -> Column:
    """Sorted distinct ``kind:source:slug``, ``most`` at the most, as the data model has it; null text has none."""
    found = [_kind(text, source, kind, shape) for kind, shape in ENTITY_SHAPES]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*found))), 1, most)


def match_key(entity: Column) -> Column:
    """An entity without its source."""
    return F.regexp_replace(entity, "^([^:]*:)[^:]*:", "$1")


def noise_entity(key: Column) -> Column:
    """Whether a match key names only a role of a conversation, or a conversation by its id; null is no noise."""
    role = key.isin("person:user", "person:assistant")
    return F.coalesce(role | key.rlike("^topic:(?i)[0-9a-f]{8}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{12}$"), F.lit(False))


def _resolve(phrase: Column, at: Column) -> Column:
    """(day, confidence) of a lower-case phrase seen on date ``at``."""
    number = F.regexp_extract(phrase, "([0-9]{1,3}) ", 1).try_cast("int")
    days = number * F.when(phrase.contains("week"), UNIT_DAYS["week"]).otherwise(UNIT_DAYS["day"])
    month = F.coalesce(*[F.when(phrase.startswith(m), F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    dated = F.concat_ws("-", F.regexp_extract(phrase, "([0-9]{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(phrase, " ([0-9]{1,2}),", 1), 2, "0"))
    day = (
        F.when(phrase == "today", at)
        .when(phrase == "yesterday", F.date_add(at, -1))
        .when(phrase == "tomorrow", F.date_add(at, 1))
        .when(phrase.endswith("ago"), F.date_sub(at, days))
        .when(phrase.startswith("in "), F.date_add(at, days))
        .when(month.isNotNull(), dated.try_cast("date"))
        .otherwise(phrase.try_cast("date"))
    )
    sure = F.when(phrase.rlike("[0-9]{4}"), 1.0).when(phrase.rlike("[0-9]"), 0.7).otherwise(0.8)
    return F.struct(phrase.alias("phrase"), day.alias("day"), sure.alias("confidence"))


def time_anchors(text: Column, at: Column) -> Column:
    """Anchors in the order of the text: ISO and English dates, day words and spans. Impossible dates are left out."""
    phrases = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({ANCHOR_SHAPE})"), F.lit(1))
    return F.filter(F.transform(phrases, lambda p: _resolve(p, at)), lambda x: x["day"].isNotNull())


def anchor_step(days: Column) -> Column:
    return F.when(F.abs(days) <= 1, 1.0).when(F.abs(days) <= 7, 0.5).otherwise(0.0)


def chunks(text: Column, window: int, overlap: int) -> Column:
    """(k, chunk): windows of ``window`` characters, each starting ``overlap`` before the last one's end."""
    step = window - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), F.substring(text, k * step + 1, F.lit(window)).alias("chunk")))


#: Marks between turns, the most specific first; the first that a text has cuts it.
TURN_MARKS = ("\n---\n", "\n\n## ")


def _with_mark(n: int):
    return lambda x, i: F.length(x) + F.when(i > 0, n).otherwise(0)


def turn_chunks(text: Column, window: int, overlap: int) -> Column:
    """Spans (start, end) of a text's chunks, in code points: turns packed greedily into windows.

    A turn keeps the mark before it and is cut only if it alone is longer than a window. The next window begins with the
    last ``overlap`` characters of the one before. Chunks are contiguous, so the fold is over lengths and no text is copied.
    A null or empty text has none; ``overlap`` is half a window at most.
    """
    if 2 * overlap > window:
        raise ValueError("overlap is half a window at most")
    whole = F.array(F.length(text))
    cuts = whole
    for mark in reversed(TURN_MARKS):
        parts = F.split(text, mark, -1)
        cuts = F.when(F.contains(text, F.lit(mark)), F.transform(parts, _with_mark(len(mark)))).otherwise(cuts)
    pieces = lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / window).cast("int")), lambda k: F.least(F.lit(window), n - k * window))
    sizes = F.flatten(F.transform(F.filter(cuts, lambda n: n > 0), pieces))
    span = lambda s, e: F.array(F.struct(s.cast("int").alias("start"), e.cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(none.alias("done"), F.lit(0).alias("s"), F.lit(0).alias("e"))

    def step(at: Column, n: Column) -> Column:
        s, e = at["s"], at["e"]
        end = e + n
        fits = (s == e) | (end - s <= window)
        tail = F.greatest(s, e - overlap)
        over = end - tail > window
        done = F.when(fits, at["done"]).when(over, F.concat(at["done"], span(s, e), span(tail, tail + window))).otherwise(F.concat(at["done"], span(s, e)))
        first = F.when(fits, s).when(over, tail + (window - overlap)).otherwise(tail)
        return F.struct(done.alias("done"), first.cast("int").alias("s"), end.cast("int").alias("e"))

    packed = F.aggregate(sizes, begin, step, lambda at: F.when(at["e"] > at["s"], F.concat(at["done"], span(at["s"], at["e"]))).otherwise(at["done"]))
    return F.coalesce(packed, none)


def fact_of_chunk(chunk: Column) -> Column:
    """The id without ``#`` and the chunk's number."""
    return F.regexp_replace(chunk, "^(.+)#[0-9]+$", "$1")


def context_prefix(thread: Column, source: Column, names: Column, day: Column, chars: int = 320, most: int = 8) -> Column:
    """One line of context, its entities cut from the tail until it fits."""
    line = lambda k: F.concat_ws(" ", F.concat(F.lit("Conversation: "), thread), F.concat(F.lit("Source: "), source), F.when((F.size(names) > 0) & (k > 0), F.concat(F.lit("Entities: "), F.array_join(F.slice(names, F.lit(1), k), ", "))), F.concat(F.lit("Date: "), day))
    fits = F.filter(F.transform(F.sequence(F.lit(most), F.lit(0), F.lit(-1)), line), lambda x: F.length(x) <= chars)
    return F.coalesce(F.get(fits, F.lit(0)), F.substring(line(F.lit(0)), 1, chars))
