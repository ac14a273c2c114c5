"""What admission rules ask about other rows: seen before, known elsewhere, close in time to something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.events import within


def repeated(rows: DataFrame, keys: list[str], flag: str = "duplicate") -> DataFrame:
    """Adds ``flag``: a row with equal keys comes before it by (ts, id), which must be one row's own.

    Each key's first row comes from an aggregate, so a frequent key costs one row a task before the join.
    A null key repeats nothing.
    """
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    first = rows.where(whole).groupBy(*keys).agg(F.min(F.struct("ts", "id")).alias("_first"))
    return rows.join(first, keys, "left").withColumn(flag, F.coalesce(F.struct("ts", "id") > F.col("_first"), F.lit(False))).drop("_first").select(*rows.columns, flag)


def replayed_prompts(rows: DataFrame) -> DataFrame:
    """Adds ``seen_before`` to session rows ``id, ts, text``: the same system prompt came earlier that UTC day."""
    marked = rows.withColumn("_hash", F.sha2("text", 256)).withColumn("_day", F.to_date("ts"))
    return repeated(marked, ["_hash", "_day"], "seen_before").drop("_hash", "_day")


def near(rows: DataFrame, others: DataFrame, keys: list[str], seconds: int, flag: str) -> DataFrame:
    """Adds ``flag``: another table has a row of equal keys at most ``seconds`` away. Both have ts, ``rows`` an id."""
    key = F.when(F.forall(F.array(*[F.col(k).cast("string") for k in keys]), lambda x: x.isNotNull()), F.to_json(F.struct(*keys)))
    at = F.unix_micros("ts").alias("at")
    hit = within(rows.select("id", key.alias("_key"), at), others.select(key.alias("_key"), at), "_key", seconds * 1_000_000)
    return rows.join(hit.select("id", F.lit(True).alias(flag)).distinct(), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).select(*rows.columns, flag)


def paired_branches(events: DataFrame, activity: DataFrame) -> DataFrame:
    """Adds ``paired`` to branch events ``id, ts, repo, ref``: a push or pull request of the branch within a day."""
    return near(events, activity, ["repo", "ref"], 86400, "paired")


def known_pushes(pushes: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds ``duplicate`` to pushes ``repo, head``: the local log of the repository's last path part has that commit."""
    base = F.lower(F.regexp_extract("repo", "([^/]+?)(\\.git)?/?$", 1))
    known = commits.select(base.alias("_base"), F.col("sha").alias("head")).distinct().withColumn("duplicate", F.lit(True))
    got = pushes.withColumn("_base", base).join(known, ["_base", "head"], "left")
    return got.withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).select(*pushes.columns, "duplicate")


def copied_turns(turns: DataFrame, sessions: DataFrame, seconds: int = 600) -> DataFrame:
    """Adds ``duplicate`` to transcript turns ``id, ts, folder, text``: a session row of equal text lies within ten minutes.

    The session row is of the same folder or of none. Texts meet by the first twelve digits of their hash.
    """
    short = lambda rows: rows.withColumn("_hash", F.substring(F.sha2("text", 256), 1, 12))
    own, other = short(turns), short(sessions)
    there = near(own, other.where("folder is not null"), ["_hash", "folder"], seconds, "_there")
    both = near(there, other.where("folder is null"), ["_hash"], seconds, "_any")
    return both.withColumn("duplicate", F.col("_there") | F.col("_any")).select(*turns.columns, "duplicate")
