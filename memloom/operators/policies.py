"""Policy rows over a ledger: predicates and their withdrawal, revoked sources, overlays and orphaned derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom import config as C
from memloom.operators.events import latest_wins


def active_predicates(rows: DataFrame) -> DataFrame:
    """(predicate_id, captured_at) of ``predicate_id, captured_at, action, seq``: the last action of each is not ``rescind``.

    A second withdrawal changes nothing; a withdrawal without a predicate makes none.
    """
    told = F.coalesce(F.col("action") != "rescind", F.lit(True))
    made = latest_wins(rows, "predicate_id", "seq").where(told)
    return made.select("predicate_id", "captured_at")


def list_predicates(active: DataFrame, most: int = C.PREDICATES_MAX) -> DataFrame:
    """(predicate_id, captured_at, total_active, truncated): the first ``most`` by time of capture and id."""
    total = active.agg(F.count("*").alias("total_active"))  # one row, so the product below is bounded
    first = active.orderBy("captured_at", "predicate_id").limit(most)
    return first.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_active") > most)


def revoked_ids(refs: DataFrame, revoked: DataFrame) -> DataFrame:
    """(id): memories ``id, source_refs`` that rest on a revoked ``source_ref``, each once."""
    each = refs.select("id", F.explode("source_refs").alias("source_ref"))
    return each.join(revoked.select("source_ref"), "source_ref", "left_semi").select("id").distinct()


def overlay(candidates: DataFrame, backfills: DataFrame, channels: list[str]) -> DataFrame:
    """Candidates with each channel replaced by that of the latest row of ``target, version, ts, id`` for their id, where it has one."""
    last = latest_wins(backfills, "target", "version", "ts", "id").select(F.col("target").alias("id"), *[F.col(c).alias(f"new_{c}") for c in channels])
    made = candidates.join(last, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in channels})
    return made.select(*candidates.columns)


def derivation_gate(rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """(id, gate) of ``id, kind, parents`` with unique ids: 0 for a reconstructed row all of whose parents are orphans, else 1.

    A row that names no parent keeps 1. The anti-join finds rows with a live parent.
    """
    named = rows.where("kind = 'reconstructed'").select("id", F.explode("parents").alias("parent")).where("parent is not null")
    live = named.join(orphans.select(F.col("id").alias("parent")), "parent", "left_anti").select("id").distinct().withColumn("live", F.lit(True))
    derived = (F.col("kind") == "reconstructed") & F.exists("parents", lambda p: p.isNotNull())
    gone = F.coalesce(derived & F.col("live").isNull(), F.lit(False))
    return rows.join(live, "id", "left").select("id", F.when(gone, 0.0).otherwise(1.0).alias("gate"))
