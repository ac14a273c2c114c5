"""Session logs of coding agents: messages out of their JSON lines, and turns out of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import written


def content_text(content: Column) -> Column:
    """The text of a message's content as JSON: a string as it is, of a list the non-empty texts with blank lines between."""
    parts = F.from_json(content, "array<struct<text:string>>")
    said = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: F.coalesce(t != "", F.lit(False)))
    listed = F.coalesce(content, F.lit("")).rlike(r"^\s*\[")
    return F.when(listed, F.coalesce(F.array_join(said, "\n\n"), F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def messages(lines: DataFrame) -> DataFrame:
    """(session, seq, ts, role, text) of log lines ``session, seq, timestamp, type, payload`` (JSON): those that are messages."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    rows = lines.where((F.col("type") == "response_item") & (field("type") == "message"))
    return rows.select("session", "seq", F.col("timestamp").alias("ts"), field("role").alias("role"), content_text(field("content")).alias("text"))


def pair_turns(rows: DataFrame) -> DataFrame:
    """(session, turn_index, ts, user_text, assistant_text, developer_texts) of messages ``session, seq, ts, role, text``.

    An assistant's message makes a turn with the user's before it, if that stands right before; a user's message that no assistant
    answers makes one alone. Turns are numbered from 0 in each session. Developers' messages belong to all turns from one assistant's message to
    the next; of other roles only the time counts. The time is the assistant's, else the user's, else the last one known when the turn was closed.

    No window holds a session: rows are dealt by ranges of session and place, and each range tells the others what
    it begins and ends with and how much it counted, so a session may be half of the table. A session's places differ.
    """
    known = rows.where(F.col("session").isNotNull())
    ranged = known.select("session", "seq", "ts", "role", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(F.col("session"), F.col("seq"))
    placed = written(ranged.withColumn("part", F.spark_partition_id()), "messages")  # written, so that a row keeps its part
    local = Window.partitionBy("session", "part").orderBy("seq")
    speaks = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    # The last time up to the row, in its part.
    timed = placed.withColumns({"last_ts": F.last("ts", ignorenulls=True).over(local), "assistants": F.count_if(F.col("role") == "assistant").over(local.rowsBetween(Window.unboundedPreceding, -1))})
    said = F.struct("role", "text", "ts")
    turns = timed.where(speaks)
    near = turns.withColumns({"next": F.lead(F.struct("role", "last_ts")).over(local), "before": F.lag(said).over(local)})
    # What a part begins and ends with; one row a session and part.
    spoken = F.when(speaks, F.col("seq"))
    ends = timed.groupBy("session", "part").agg(
        F.min_by(F.when(speaks, F.struct("role", "last_ts")), spoken).alias("first"), F.max_by(F.when(speaks, said), spoken).alias("last"),
        F.max_by("last_ts", "seq").alias("end_ts"), F.count_if(F.col("role") == "assistant").alias("n_assistants"),
    )
    over = Window.partitionBy("session").orderBy("part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    later = over.rowsBetween(1, Window.unboundedFollowing)
    around = ends.select(
        "session", "part", F.first("first", ignorenulls=True).over(later).alias("first_after"), F.last("last", ignorenulls=True).over(earlier).alias("last_before"),
        F.last("end_ts", ignorenulls=True).over(earlier).alias("ts_before"), F.coalesce(F.sum("n_assistants").over(earlier), F.lit(0)).alias("assistants_before"),
        F.last("end_ts", ignorenulls=True).over(Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("session_ts"),
    )
    met = near.join(around, ["session", "part"])
    after, prior = F.coalesce("next", "first_after"), F.coalesce("before", "last_before")
    mine, user_before = F.col("role") == "assistant", prior["role"] == "user"
    closed = F.coalesce(F.col("last_ts"), F.col("ts_before"))
    # A user's message that is left alone is closed by the next user's message, or by the end of the session.
    closing = F.when(after.isNull(), F.col("session_ts")).otherwise(F.coalesce(after["last_ts"], closed))
    made = met.where(mine | ~F.coalesce(after["role"] == "assistant", F.lit(False))).select(
        "session", "part", "seq", (F.col("assistants") + F.col("assistants_before")).alias("island"),
        F.when(mine, F.coalesce("ts", F.when(user_before, prior["ts"]), closed)).otherwise(F.coalesce(F.col("ts"), closing)).alias("ts"),
        F.when(~mine, F.col("text")).when(user_before, prior["text"]).otherwise("").alias("user_text"), F.when(mine, F.col("text")).otherwise("").alias("assistant_text"),
    )
    made = written(made, "turns")
    counts = made.groupBy("session", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("session", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = made.withColumn("at", F.row_number().over(local) - 1).join(offsets, ["session", "part"])
    told = timed.where((F.col("role") == "developer") & (F.col("text") != "")).join(around.select("session", "part", "assistants_before"), ["session", "part"])
    developers = told.groupBy("session", (F.col("assistants") + F.col("assistants_before")).alias("island")).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("d"))
    none = F.array().cast("array<string>")
    whole = numbered.join(developers, ["session", "island"], "left")
    return whole.select("session", (F.col("at") + F.col("offset")).alias("turn_index"), "ts", "user_text", "assistant_text", F.coalesce(F.transform("d", lambda x: x["text"]), none).alias("developer_texts"))
