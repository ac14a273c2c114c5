"""Health of a memory store: day folds that merge, lags, costs, liveness and alerts.

Folds group by source and day with partial aggregates only, so a source with most of the rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom import config as C


def day_partials(rows: DataFrame) -> DataFrame:
    """(source, day, n, blank, total, high) of rows ``source, ts, blank, value``, by UTC day of the session's zone.

    Rows of two folds merge by addition, and ``high`` by maximum. Rows without a time aren't in any day.
    """
    return rows.where("ts is not null").groupBy("source", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("blank", F.lit(False))).alias("blank"),
        F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("total"), F.max("value").alias("high"),
    )


def merge_days(days: DataFrame, today: Column, keep: int = C.HEALTH_DAYS) -> DataFrame:
    """(source, days, n, blank, total, high): day rows of the last ``keep`` days, also where a day comes in several parts."""
    age = F.datediff(today, "day")
    return days.where((age >= 0) & (age < keep)).groupBy("source").agg(
        F.count_distinct("day").alias("days"), F.sum("n").alias("n"), F.sum("blank").alias("blank"), F.sum("total").alias("total"), F.max("high").alias("high")
    )


def funnel_alert(rows: DataFrame, least: int = C.FUNNEL_ROWS) -> DataFrame:
    """(source, n, drop_rate, alert) of rows ``source, decision``: an alert if all of at least ``least`` rows were dropped."""
    kept = F.count_if(F.coalesce(F.col("decision") == "PASS", F.lit(False)))
    made = rows.groupBy("source").agg(F.count("*").alias("n"), kept.alias("kept"))
    return made.select("source", "n", (1 - F.col("kept") / F.col("n")).alias("drop_rate"), ((F.col("n") >= least) & (F.col("kept") == 0)).alias("alert"))


def capture_staleness(rows: DataFrame, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """(source, n, age_seconds, stale) of rows ``source, ts``: the age of the last row above the source's hours.

    A source whose rows have no time can't be measured: its age and ``stale`` are null.
    """
    bound = F.lit(C.STALE_HOURS)
    for source, h in (hours or {}).items():
        bound = F.when(F.col("source") == source, h).otherwise(bound)
    made = rows.groupBy("source").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    age = F.unix_seconds(now) - F.unix_seconds("last")
    return made.select("source", "n", age.alias("age_seconds"), (age > 3600 * bound).alias("stale"))


def cursor_lag(tails: DataFrame, cursors: DataFrame, now: Column) -> DataFrame:
    """(source, lag_ms, growing, warned) of ``source, tail_ts, modified`` and ``source, cursor_ts``, a row a source each.

    A ledger grows if it was modified in the last hour or has no such time; without a tail or a cursor there is no lag.
    """
    rows = tails.join(cursors.select("source", "cursor_ts"), "source", "left")
    lag = F.unix_millis("tail_ts") - F.unix_millis("cursor_ts")
    growing = F.coalesce(F.unix_millis(now) - F.unix_millis("modified") < C.LAG_GROWTH_MS, F.lit(True))
    return rows.select("source", lag.alias("lag_ms"), growing.alias("growing"), F.coalesce((lag > C.LAG_WARN_MS) & growing, F.lit(False)).alias("warned"))


def embed_cost(calls: DataFrame) -> DataFrame:
    """(day, model, source, calls, tokens, cost) of rows ``ts, model, source, tokens, price``; the price is for a million tokens, null costs nothing."""
    paid = F.col("tokens") * F.col("price") / 1e6
    return calls.groupBy(F.to_date("ts").alias("day"), "model", "source").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(paid), F.lit(0.0)).alias("cost")
    )


def hostname_dominance(commits: DataFrame, share: float = C.HOSTNAME_SHARE) -> DataFrame:
    """(total, matches, fraction, warned) of rows ``matched``: too many commits by addresses made out of a host's name."""
    made = commits.agg(F.count("*").alias("total"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matches"))
    fraction = F.coalesce(F.try_divide("matches", "total"), F.lit(0.0))
    return made.select("total", "matches", fraction.alias("fraction"), (fraction > share).alias("warned"))


def index_coverage(eligible: DataFrame, indexed: DataFrame, floor: float) -> DataFrame:
    """(eligible, indexed, ratio, ok) of ids: the share of eligible ids that the index has, each id once."""
    have = indexed.select("id").distinct().withColumn("have", F.lit(1))
    made = eligible.select("id").distinct().join(have, "id", "left").agg(F.count("*").alias("eligible"), F.count("have").alias("indexed"))
    ratio = F.coalesce(F.try_divide("indexed", "eligible"), F.lit(0.0))
    return made.select("eligible", "indexed", ratio.alias("ratio"), (ratio >= floor).alias("ok"))


def liveness(recalls: DataFrame, least: int = C.LIVE_ROWS, share: float = C.LIVE_SHARE) -> DataFrame:
    """(sample, rate, verdict) of rows ``found``: ``inconclusive`` below ``least`` rows, else ``green`` or ``red``."""
    made = recalls.agg(F.count("*").alias("sample"), F.coalesce(F.avg(F.coalesce("found", F.lit(False)).cast("int")), F.lit(0.0)).alias("rate"))
    verdict = F.when(F.col("sample") < least, "inconclusive").when(F.col("rate") >= share, "green").otherwise("red")
    return made.withColumn("verdict", verdict)
