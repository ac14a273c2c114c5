"""Event-log operators: latest wins, duplicates, damping, feedback and day folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.scoring import engagement_recency, feedback_score
from memloom.functions.text import content_hash, normalised


def latest_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by partial aggregation: a hot key never meets in one task."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row")).select(key, "row.*")


def content_dedup(docs: DataFrame) -> DataFrame:
    """(hash, id of the first, number of copies)."""
    return docs.groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("id").alias("id"), F.count("*").alias("duplicate_count"))


def rolling_template(rows: DataFrame, seconds: int, k: int) -> DataFrame:
    """Adds n_window (rows of the same template and sender in the last ``seconds``) and drop (``>= k``)."""
    w = Window.partitionBy("template", "sender").orderBy("at").rangeBetween(-seconds, 0)
    return rows.withColumn("n_window", F.count("*").over(w)).withColumn("drop", F.col("n_window") >= k)


def burst_collapse(rows: DataFrame, seconds: int = 5) -> DataFrame:
    """Adds keep: false within ``seconds`` of the row before of the same handle."""
    w = Window.partitionBy("handle").orderBy("at", "id")
    return rows.withColumn("keep", F.coalesce(F.col("at") - F.lag("at").over(w) > seconds, F.lit(True)))


def within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Left rows with a right row of the same key at most ``seconds`` apart.

    Both sides fall into time buckets of that length, and the left looks at three: an equi-join on
    (key, bucket), which stays small when one key is hot.
    """
    r = right.select(F.col(key).alias("k"), F.col("at").alias("r_at"), F.floor(F.col("at") / seconds).alias("bucket")).distinct()
    near = left.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("at") / seconds) + d for d in (-1, 0, 1)])))
    met = near.join(r, (near[key] == r["k"]) & (near["bucket"] == r["bucket"]) & (F.abs(near["at"] - r["r_at"]) <= seconds), "left_semi")
    return met.drop("bucket").distinct()


def feedback(rows: DataFrame) -> DataFrame:
    """(subject, total, score) over actions with fixed weights."""
    weight: Column = F.lit(0.0)
    for action, w in C.FEEDBACK.items():
        weight = F.when(F.col("action") == action, F.lit(w)).otherwise(weight)
    return rows.groupBy("subject").agg(F.sum(weight).alias("total")).select("subject", "total", feedback_score(F.col("total")).alias("score"))


def engagement_prior(rows: DataFrame, now: Column) -> DataFrame:
    """(subject, n, prior): log1p(n) times the recency of the last."""
    last = rows.groupBy("subject").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    days = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 86400
    return last.select("subject", "n", (F.log1p("n") * engagement_recency(days)).alias("prior"))


def damping(rows: DataFrame, now: Column) -> DataFrame:
    """(subject, coefficient): 1 plus the signals of the window, clamped; an expunged subject has the lowest.

    Signals are surfacing, the classes of an engagement, inherited (an engagement passed on by a derived
    row) and expunged, which counts at any time; unknown ones and rows without a time add nothing.
    """
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400
    seen = (age <= C.DAMPING_DAYS) & (age >= -1)
    part = F.when(~seen | F.col("ts").isNull(), 0.0)
    for signal, adds in C.DAMPING.items():
        part = part.when(F.col("signal") == signal, adds)
    part = part.otherwise(0.0)
    sums = rows.groupBy("subject").agg(F.sum(part).alias("s"), F.max((F.col("signal") == "expunged").cast("int")).alias("gone"))
    clamped = F.least(F.lit(C.DAMPING_HIGH), F.greatest(F.lit(C.DAMPING_LOW), 1 + F.col("s")))
    return sums.select("subject", F.when(F.col("gone") == 1, F.lit(C.DAMPING_LOW)).otherwise(clamped).alias("coefficient"))


def _earliest(facts: DataFrame, keys: list[str], least: int, keep: int, chars: int) -> DataFrame:
    """One row a group with at least ``least`` facts: the earliest ``keep``, joined and cut.

    Rows are ranked before they are gathered, so no group gathers more than ``keep``.
    """
    w = Window.partitionBy(*keys)
    rows = facts.withColumns({"rn": F.row_number().over(w.orderBy("ts", "id")), "n": F.count("*").over(w)}).where((F.col("n") >= least) & (F.col("rn") <= keep))
    made = rows.groupBy(*keys).agg(F.max("n").alias("n_facts"), F.array_sort(F.collect_list(F.struct("rn", "content"))).alias("parts"))
    return made.select(*keys, "n_facts", F.substring(F.array_join("parts.content", "\n"), 1, chars).alias("content"))


def thread_days(facts: DataFrame, least: int = C.THREAD_MIN, keep: int = C.THREAD_KEEP, chars: int = C.THREAD_CHARS) -> DataFrame:
    """One row a (source, thread, day)."""
    return _earliest(facts, ["source", "thread", "day"], least, keep, chars)


def project_weeks(facts: DataFrame, least: int = C.PROJECT_MIN, keep: int = C.PROJECT_KEEP, chars: int = C.PROJECT_CHARS) -> DataFrame:
    """One row a (repo, author, year, week) of ISO weeks."""
    dated = facts.withColumns({"year": F.extract(F.lit("YEAROFWEEK"), "ts"), "week": F.extract(F.lit("WEEK"), "ts")})
    return _earliest(dated, ["repo", "author", "year", "week"], least, keep, chars)


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(day, n, one share a field): day grain, so that days merge by their counts."""
    return rows.groupBy("day").agg(F.count("*").alias("n"), *[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields])


def drift(days: DataFrame, fields: list[str], today: Column, recent: int = 7, baseline: int = 30) -> DataFrame:
    """(field, before, after, level): the last week's coverage against the weeks before, from day rows."""
    age = F.datediff(today, "day")
    now, past = (age >= 0) & (age < recent), (age >= recent) & (age < baseline)
    share = lambda f, when: F.try_divide(F.sum(F.when(when, F.col(f) * F.col("n"))), F.sum(F.when(when, F.col("n"))))
    wide = days.agg(*[F.struct(F.lit(f).alias("field"), share(f, past).alias("before"), share(f, now).alias("after")).alias(f) for f in fields])
    drop = F.round(F.col("before") - F.col("after"), 9)
    level = F.when(drop >= 2 * C.DRIFT_POINTS, "critical").when(drop > C.DRIFT_POINTS, "warn").otherwise("ok")
    return wide.select(F.inline(F.array(*fields))).withColumn("level", level)


def retain(rows: DataFrame, cap: int) -> DataFrame:
    """The last ``cap`` rows by seq."""
    return rows.orderBy(F.desc("seq")).limit(cap)


def empty_rate(rows: DataFrame) -> DataFrame:
    """(source, n, rate, degraded): the share of blank texts, degraded above one half."""
    blank = (F.coalesce(normalised(F.col("text")), F.lit("")) == "").cast("double")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg(blank).alias("rate")).withColumn("degraded", F.col("rate") > 0.5)


def first_wins(rows: DataFrame, key: Column) -> DataFrame:
    """Per key the best row ``id, score``, ties to the lower id, and how many rows the key had."""
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id")))
    return rows.groupBy(key.alias("key")).agg(best.alias("best"), F.count("*").alias("duplicate_count")).select("key", "best.*", "duplicate_count")


def embed_census(facts: DataFrame, vectors: DataFrame, opted_out: Column) -> DataFrame:
    """(state, n): each id in one class: embedded, opted out, blank or pending."""
    have = vectors.select("id", F.lit(1).alias("have"))
    state = F.when(F.col("have").isNotNull(), "embedded").when(opted_out, "opted_out").when(F.coalesce(normalised(F.col("text")), F.lit("")) == "", "blank").otherwise("pending")
    return facts.join(have, "id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
