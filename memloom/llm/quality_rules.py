"""Quality rules as a short-circuit cascade, in built-in functions alone.

A rule is a condition that rejects a document. Each rule's time and the share of documents that it
rejects are measured on a bounded sample; the rules then stand in one CASE in order of rejections per
second, so that a document pays for the rules up to the first that rejects it. The order changes the time,
never a verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that time and selectivity are measured on, and how often a rule is timed (the least time counts).
SAMPLE, RUNS = 1_000, 2
WINDOW = 8
BULLETS = "-*•‣◦·"
BLANKS = r"[ \x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads the columns of ``measured``; a null doesn't reject."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    """Of a rule on the sample: seconds, and the share of documents that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections per second; the least measurable time stands for less."""
        return self.rejected / max(self.seconds, 1e-3)


def _share(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("n_words") < 20),
        Rule("repeated_words", _share(F.col("n_repeat_words"), F.col("n_words"), 30)),
    ]


def rules() -> list[Rule]:
    """The rules of the cascade beside the base; shares are far from what running prose has in any cased script."""
    text, lines, n, chars = F.col("text"), F.col("lines"), F.col("n_words"), F.col("word_chars")
    count = lambda kinds: F.length(F.regexp_replace(text, f"[^{kinds}]+", ""))
    of_lines = lambda like: F.size(F.filter(lines, like))
    # Sorted, a word with over 30 % of the places stands at a multiple of that many places, and again as many after its first.
    codes, step = F.col("sorted_codes"), F.floor(30 * n / 100).cast("int")
    candidates = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(codes, k * step))
    held = lambda w: w == F.get(codes, F.array_position(codes, w).cast("int") - 1 + step)
    return [
        Rule("word_length", (2 * chars < 5 * n) | (chars > 12 * n)),
        Rule("longest_word", F.col("longest") > 1000),
        Rule("symbols", _share(F.col("n_symbols"), n, 10)),
        Rule("duplicate_lines", _share(F.col("n_dup_lines"), F.size(lines), 50)),
        Rule("bullets", _share(of_lines(lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS)), F.size(lines), 90)),
        Rule("ellipses", _share(of_lines(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")), F.size(lines), 50)),
        Rule("few_letters", _share(chars - count(r"\p{L}\p{M}"), chars, 40)),
        Rule("shouting", _share(count(r"\p{Lu}"), chars, 50)),
        Rule("one_word", F.exists(candidates, held)),
    ]


def _repeated(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of eight words that occur twice or more in the text.

    Each step is a column of its own, so that it is computed once. 64-bit hashes of windows stand for them: in a
    text of a million words two different windows meet with a chance of 3e-8. Only texts with an equal pair of hashes are sorted.
    """
    n, marks, sites = F.col("n_words"), F.col("marks"), F.col("sites")
    paired = lambda at, size: F.transform(at, lambda h, i: F.xxhash64(h, F.get(F.col(at), i + size)))
    # A window's hash is that of its halves; those that begin in the last seven words aren't windows.
    df = df.withColumns({"of_2": paired("codes", 1), "sorted_codes": F.sort_array("codes")}).drop("codes")
    df = df.withColumn("of_4", paired("of_2", 2)).drop("of_2")
    df = df.withColumn("of_8", paired("of_4", 4)).drop("of_4")
    df = df.withColumn("windows", F.slice("of_8", F.lit(1), F.greatest(F.lit(0), n - WINDOW + 1).cast("int"))).drop("of_8")
    df = df.withColumn(
        "marks",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    twin = lambda x, k: (x["h"] == F.get(marks, k - 1)["h"]) | (x["h"] == F.get(marks, k + 1)["h"])
    df = df.withColumn("sites", F.sort_array(F.transform(F.filter(marks, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        sites,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n")),
    )["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("marks", "sites")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, text, lines, the base measures and what the rules read) of each row; ``row`` has all its columns if ``keep``."""
    whole = [F.struct("*").alias("row")] if keep else []
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *whole)
    bare = F.trim(F.col("text"), F.lit(BLANK))
    df = df.withColumn("bare", bare)
    df = df.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", BLANKS))).drop("bare")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    symbols = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))
    df = df.withColumns({
        "codes": F.transform("words", lambda w: F.xxhash64(w)),
        "longest": F.array_max(F.transform("words", F.length)),
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("words")
    return _repeated(df)


def estimates(rows: DataFrame, asked: list[Rule], sample: int = SAMPLE) -> list[Estimate]:
    """Time and selectivity of each rule over at most ``sample`` rows of ``measured``, drawn by hash of id and text.

    A rule's time is the least of RUNS counts, less the same count without a rule. Sampled rows lie
    in memory and are made anew if their executor is lost.
    """
    all_rows = max(1, rows.select("doc_id").count())
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.lit(min(1.0, 1.2 * sample / all_rows) * 1_000_003)
    some = rows.where(chance).limit(sample).persist()

    def timed(condition: Column) -> tuple[float, int]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            hits = some.agg(F.count(F.when(condition, 1))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), hits

    try:
        n = max(1, some.count())
        idle, _ = timed(F.col("n_words") < 0)
        found = ((r, *timed(r.rejects)) for r in asked)
        return [Estimate(r, max(0.0, seconds - idle), hits / n) for r, seconds, hits in found]
    finally:
        some.unpersist()


def ordered(found: list[Estimate]) -> list[Rule]:
    """By rejections per second, then the cheaper, then by name."""
    return [e.rule for e in sorted(found, key=lambda e: (-e.worth, e.seconds, e.rule.name))]


def verdict(cascade: list[Rule]) -> Column:
    """The first rule in the order of ``cascade`` that rejects, or null: a CASE, which stops there."""
    if not cascade:
        return F.lit(None).cast("string")
    told = F.when(cascade[0].rejects, cascade[0].name)
    for rule in cascade[1:]:
        told = told.when(rule.rejects, rule.name)
    return told


def judge(docs: DataFrame, more: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null text has no words and fails the base, as an empty one does; null ids stay, repeated rows have equal results,
    other columns are ignored, an empty table gives no rows. ``more`` are the rules of the cascade beside the base.
    """
    rows = measured(docs, id_col, text_col)
    base, more = base_rules(), rules() if more is None else more
    cascade = ordered(estimates(rows, more, sample))
    failed = base[0].rejects | base[1].rejects
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False).otherwise(verdict(cascade).isNull())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def drop_rejected(docs: DataFrame, more: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; base rules are ordered with the others.

    Rows are judged as in ``judge``; columns of any name pass through.
    """
    rows = measured(docs, id_col, text_col, keep=True)
    every = base_rules() + (rules() if more is None else more)
    cascade = ordered(estimates(rows.drop("row"), every, sample))
    # With the partition's number in it the verdict isn't deterministic, so the filter stays above the projections; pushed
    # down, each column would be spelled out anew wherever it is used.
    told = rows.select("row", F.when(F.spark_partition_id() >= 0, verdict(cascade)).alias("verdict"))
    return told.where("verdict is null").select("row.*")
