"""Message-triage operators over turns ``thread, seq, from_me, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.text import tokens
from memloom.operators.events import latest_wins


def reciprocity(turns: DataFrame) -> DataFrame:
    """(thread, inbound, outbound, turn_count): turn_count is how often the direction changes."""
    w = Window.partitionBy("thread").orderBy("seq")
    change = F.coalesce((F.col("from_me") != F.lag("from_me").over(w)).cast("long"), F.lit(0))
    rows = turns.withColumn("change", change)
    return rows.groupBy("thread").agg(
        F.sum((~F.col("from_me")).cast("long")).alias("inbound"), F.sum(F.col("from_me").cast("long")).alias("outbound"), F.sum("change").alias("turn_count")
    )


def trailing_run(turns: DataFrame) -> DataFrame:
    """(thread, waiting): inbound messages after the last outbound one, by two aggregates."""
    last = F.max(F.when(F.col("from_me"), F.col("seq")))
    after = turns.join(turns.groupBy("thread").agg(last.alias("last_out")), "thread")
    waits = (~F.col("from_me")) & (F.col("last_out").isNull() | (F.col("seq") > F.col("last_out")))
    return after.groupBy("thread").agg(F.sum(waits.cast("long")).alias("waiting"))


def reciprocity_factor(inbound, outbound, turns):
    """1 from six turns on, from 0.7 at two; 0.3 for a broadcast; towards it the more came in unanswered, from three on; else 0.7."""
    broadcast = (inbound >= 5) & (turns <= 1) & (outbound <= 1)
    unanswered = 0.3 + 0.4 * (1 - F.least(F.lit(1.0), inbound / 5))
    return F.when(broadcast, 0.3).when(turns >= 6, 1.0).when(turns >= 2, 0.7 + 0.3 * (turns - 2) / 4).when((turns == 0) & (inbound >= 3), unanswered).otherwise(0.7)


def catchup(turns: DataFrame, top: int = 50) -> DataFrame:
    """(thread, waiting, score) of threads where the other side spoke last, best first."""
    rows = reciprocity(turns).join(trailing_run(turns), "thread").where("waiting > 0")
    score = reciprocity_factor(F.col("inbound"), F.col("outbound"), F.col("turn_count"))
    return rows.select("thread", "waiting", score.alias("score")).orderBy(F.desc("score"), F.desc("waiting"), "thread").limit(top)


def catchup_score(ts: Column, now: Column, directed: Column, reciprocity: Column, anchor: Column) -> Column:
    """Recency x directedness x reciprocity x anchor; an anchor only ever lifts.

    Recency falls in a line from 1 to 0.05 over seven days; without a time it is 0.05.
    """
    lift = F.when((anchor > 1) & (anchor < float("inf")), anchor).otherwise(1.0)
    age = (F.unix_micros(now) - F.unix_micros(ts)) / (86400e6 * C.RECENT_DAYS)
    left = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age)), F.lit(0.0))
    return (C.RECENT_FLOOR + (1 - C.RECENT_FLOOR) * left) * directed * reciprocity * lift


def catchup_order(rows: DataFrame, top: int = C.CATCHUP_ROWS) -> DataFrame:
    """The first ``top`` rows of ``thread, tier, contact, score, ts``: relationships, then saved contacts, score, last and thread.

    Scores that are null, not numbers or below 0 count as 0; rows without a time come last of their equals.
    """
    score = F.when((F.col("score") > 0) & (F.col("score") < float("inf")), F.col("score")).otherwise(0.0)
    close = F.coalesce(F.col("tier") == "relationship", F.lit(False))
    order = [F.desc(close), F.desc(F.coalesce("contact", F.lit(False))), F.desc(score), F.desc_nulls_last("ts"), F.asc_nulls_first("thread")]
    return rows.orderBy(*order).limit(min(top, C.CATCHUP_MOST))


def last_rows(turns: DataFrame) -> DataFrame:
    """The last row of each thread by ``seq``, by partial aggregation."""
    return latest_wins(turns, "thread", "seq")


def round_robin(rows: DataFrame, take: int = 1) -> DataFrame:
    """Adds round: rows of each platform in order of rank, ``take`` a round."""
    w = Window.partitionBy("platform").orderBy("rank", "id")
    return rows.withColumn("round", F.floor((F.row_number().over(w) - 1) / take))


def directedness(dm: Column, signals: dict[str, Column], first_class: dict[str, Column], self_known: Column, structured: Column) -> Column:
    """How surely a message is for its reader, in [0, 1].

    A channel that the platform lacks is dead; a share of its weight goes to the live ones in proportion.
    The mention channel counts less where the reader's identity or the mentions are loose. A direct
    message starts from a prior, and evidence fills the rest.
    """
    trust = F.when(self_known, 1.0).otherwise(C.MENTION_UNSURE) * F.when(structured, 1.0).otherwise(C.MENTION_LOOSE)
    live = {k: F.when(first_class[k], w).otherwise(0.0) for k, w in C.DIRECTED_WEIGHTS.items()}
    alive = sum(live.values(), F.lit(0.0))
    grown = 1 + F.coalesce(F.try_divide(C.DIRECTED_SHIFT * (1 - alive), alive), F.lit(0.0))
    parts = [live[k] * grown * F.when(signals[k], 1.0).otherwise(0.0) * (trust if k == "mention" else 1) for k in live]
    evidence = F.least(F.lit(1.0), sum(parts, F.lit(0.0)))
    prior = F.when(dm, C.DIRECTED_DM).otherwise(0.0)
    return prior + evidence * (1 - prior)


def substance(text: Column) -> Column:
    """0 without words, 1 for a question or from eight words, from one half up between five and eight, else 0."""
    n = F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "[ \t\n\r\f\v]+"), lambda t: t != ""))
    return F.when(n == 0, 0.0).when(text.contains("?"), 1.0).when(n >= 8, 1.0).when(n <= 4, 0.0).otherwise(0.5 + 0.5 * (n - 4) / 4)


def gap_trend(rows: DataFrame) -> DataFrame:
    """(thread, n, ratio, trend) of rows ``thread, at, id``: the last gap against the mean of those before."""
    w = Window.partitionBy("thread").orderBy("at", "id")
    gaps = rows.withColumn("gap", F.col("at") - F.lag("at").over(w)).where("gap is not null")
    sums = gaps.groupBy("thread").agg(F.count("*").alias("n"), F.sum("gap").alias("sum"), F.max_by("gap", F.struct("at", "id")).alias("last"))
    ratio = F.try_divide(F.col("last") * (F.col("n") - 1), F.col("sum") - F.col("last"))
    trend = F.when(ratio <= 0.8, "accelerating").when(ratio >= 1.2, "cooling").otherwise("steady")
    return sums.select("thread", "n", ratio.alias("ratio"), trend.alias("trend"))


def topics(messages: DataFrame, top: int = C.TOPIC_TOP, filler: float = C.TOPIC_FILLER_DF) -> DataFrame:
    """(person, term, tf, rank): the most frequent words and adjacent pairs of ``person, thread, text``.

    Terms in at least ``filler`` of a person's threads are filler, if there are several threads.
    """
    words = tokens(F.col("text"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    per = messages.select("person", "thread", words.alias("w")).select("person", "thread", F.explode(F.concat("w", pairs)).alias("term"))
    counts = per.groupBy("person", "thread", "term").agg(F.count("*").alias("n")).groupBy("person", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    threads = messages.select("person", "thread").distinct().groupBy("person").agg(F.count("*").alias("threads"))
    kept = counts.join(threads, "person").where((F.col("threads") == 1) | (F.col("df") < filler * F.col("threads")))
    w = Window.partitionBy("person").orderBy(F.desc("tf"), "term")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("person", "term", "tf", "rank")


def staleness(age_hours: Column) -> Column:
    return F.when(age_hours < 1, "fresh").when(age_hours < 24, "today").when(age_hours < 168, "stale").otherwise("dead")


def plausible(ts: Column, now: Column) -> Column:
    """The timestamp, or null before 2008 or over a day ahead."""
    second = F.unix_seconds(ts)
    return F.when((second >= C.EARLIEST_SECOND) & (second <= F.unix_seconds(now) + 86400), ts)


def recency(ts: Column, now: Column) -> Column:
    """1 now and ahead, falling to 0.05 over seven days; 0.05 for null."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / (86400e6 * C.RECENT_DAYS)
    return F.coalesce(F.when(age <= 0, 1.0).otherwise(F.greatest(F.lit(C.RECENT_FLOOR), 1 - age)), F.lit(C.RECENT_FLOOR))


def cadence(ts: Column, now: Column) -> Column:
    factor = recency(plausible(ts, now), now)
    return F.when(factor >= C.CADENCE_RECENT, "recent").when(factor <= C.CADENCE_DORMANT, "dormant").otherwise("regular")


def tier(contact: Column, feedback: Column, strength: Column, kind: Column) -> Column:
    """``relationship`` for contacts, for any positive feedback, and for persons who write back and forth."""
    person = ~F.coalesce(kind, F.lit("person")).isin("bot", "service", "system")
    close = F.coalesce(contact, F.lit(False)) | F.coalesce(feedback > 0, F.lit(False)) | (F.coalesce(strength >= C.TIER_RECIPROCITY, F.lit(False)) & person)
    return F.when(close, "relationship").otherwise("unknown")


def personas(messages: DataFrame, contacts: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """(person, handles, name, strength, tier, cadence, last_ts, topics) by left joins of frames with a row a person.

    ``messages``: person, thread, seq, from_me, handle, name, kind, ts, text; ``contacts``: handle, name;
    ``feedback``: person, score. A handle in contacts makes a contact and gives the name, else the first that was seen.
    A person's strength is the best of their threads.
    """
    inbound = messages.where(~F.col("from_me"))
    seen = inbound.groupBy("person").agg(
        F.array_sort(F.collect_set("handle")).alias("handles"), F.min_by("name", F.struct("ts", "thread", "seq")).alias("observed"),
        F.min("kind").alias("kind"), F.max(plausible(F.col("ts"), now)).alias("last_ts"),
    )
    whose = messages.groupBy("thread").agg(F.min(F.when(~F.col("from_me"), F.col("person"))).alias("person"))
    ties = reciprocity(messages).join(whose, "thread").groupBy("person")
    strength = ties.agg(F.max(reciprocity_factor(F.col("inbound"), F.col("outbound"), F.col("turn_count"))).alias("strength"))
    listed = inbound.select("person", "handle").distinct().join(contacts.groupBy("handle").agg(F.min("name").alias("n")), "handle")
    known = listed.groupBy("person").agg(F.min_by("n", "handle").alias("listed"), F.lit(True).alias("contact"))
    about = topics(inbound.select("person", "thread", "text")).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("k"), "term"))), lambda t: t["term"]).alias("topics"))
    rows = seen.join(strength, "person", "left").join(known, "person", "left").join(feedback.select("person", "score"), "person", "left").join(about, "person", "left")
    return rows.select(
        "person", "handles", F.coalesce("listed", "observed").alias("name"), "strength", tier(F.col("contact"), F.col("score"), F.col("strength"), F.col("kind")).alias("tier"),
        cadence(F.col("last_ts"), now).alias("cadence"), "last_ts", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )
