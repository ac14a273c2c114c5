"""Salience of incoming rows, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.text import content_hash


def by_source(source: Column, values: dict[str, float], other: float) -> Column:
    made = F.lit(other)
    for name, v in values.items():
        made = F.when(source == name, F.lit(v)).otherwise(made)
    return made


def recency(days: Column, source: Column) -> Column:
    return F.exp(-F.greatest(days, F.lit(0.0)) / by_source(source, C.TAU_DAYS, 90.0))


def novelty(distance: Column, index_size: int) -> Column:
    """Distance to the nearest fact, drawn to one half while the index is small; a missing one is one half."""
    share = min(1.0, index_size / C.NOVELTY_LERP)
    return F.coalesce(0.5 + share * (F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance)) - 0.5), F.lit(0.5))


def salience(components: dict[str, Column]) -> Column:
    return sum((w * components[k] for k, w in C.SALIENCE.items()), F.lit(0.0))


def decide(rows: DataFrame, ledger: DataFrame, index_size: int) -> DataFrame:
    """Adds decision: CORROBORATE for a copy of a ledger fact or of an earlier row, or for one too near a fact; else PROMOTE.

    Rows ``id, seq, source, text, distance, own_words``; ``ledger`` has the hashes of facts. Earlier rows
    count by an aggregate over hashes, so a third of all rows with one text is no single task's work.
    """
    hashed = rows.withColumn("hash", content_hash(F.coalesce("text", F.lit(""))))
    first = hashed.groupBy("hash").agg(F.min("seq").alias("first"))
    known = first.join(ledger.select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left")
    near = F.lit(index_size >= C.CORROBORATE_INDEX) & (F.col("distance") < by_source(F.col("source"), C.CORROBORATE_DISTANCE, 0.25)) & ~F.coalesce("own_words", F.lit(False))
    copy = F.coalesce("known", F.lit(False)) | (F.col("seq") > F.col("first"))
    made = hashed.join(known, "hash").withColumn("decision", F.when(copy | F.coalesce(near, F.lit(False)), "CORROBORATE").otherwise("PROMOTE"))
    return made.drop("first", "known")
