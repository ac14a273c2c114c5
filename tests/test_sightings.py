"""What admission asks about other rows, and personas."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.operators import admission, messaging, sightings

START = datetime(2024, 1, 1, 23, 0)


def at(minutes):
    return START + timedelta(minutes=minutes)


def flags(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_replayed_prompts_by_day(spark):
    rows = spark.createDataFrame([(1, at(0), "a"), (2, at(10), "a"), (3, at(90), "a"), (4, at(0), None), (5, at(1), None), (6, at(0), "b"), (7, at(0), "b")], "id long, ts timestamp, text string")
    assert flags(sightings.replayed_prompts(rows), "seen_before") == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert sightings.replayed_prompts(rows.limit(0)).count() == 0


def test_paired_branches(spark):
    shape = "id long, ts timestamp, repo string, ref string"
    rows = spark.createDataFrame([(1, at(0), "r", "x"), (2, at(0), "r", "y"), (3, at(3000), "r", "x"), (4, at(0), None, "x"), (5, at(1440), "r", "x")], shape)
    activity = spark.createDataFrame([(0, at(0), "r", "x"), (0, at(0), "r", "x"), (0, at(0), None, "x")], shape)
    assert flags(sightings.paired_branches(rows, activity), "paired") == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_known_pushes(spark):
    pushes = spark.createDataFrame([(1, "me/Tool.git", "s1"), (2, "me/other", "s1"), (3, None, "s1"), (4, "me/tool/", None)], "id long, repo string, head string")
    commits = spark.createDataFrame([("/home/me/tool", "s1"), ("/home/me/tool", "s1")], "repo string, sha string")
    assert flags(sightings.known_pushes(pushes, commits), "duplicate") == {1: True, 2: False, 3: False, 4: False}


def test_copied_turns(spark):
    shape = "id long, ts timestamp, folder string, text string"
    turns = spark.createDataFrame([(1, at(0), "f", "x"), (2, at(11), "f", "x"), (3, at(0), "g", "x"), (4, at(0), "g", "any"), (5, at(0), None, None)], shape)
    sessions = spark.createDataFrame([(0, at(0), "f", "x"), (0, at(9), None, "any"), (0, at(0), None, None)], shape)
    got = sightings.copied_turns(turns, sessions)
    assert flags(got, "duplicate") == {1: True, 2: False, 3: False, 4: True, 5: False}
    told = admission.admit(got.withColumn("source", F.lit("chat-transcript")))
    assert {r.id: r.reason or r.structural_score for r in told.collect()} == {1: "cross_source_duplicate", 2: 0.55, 3: 0.55, 4: "cross_source_duplicate", 5: "empty_turn"}


def test_personas(spark):
    old, now = datetime(1990, 1, 1), F.lit("2024-01-02").cast("timestamp")
    rows = spark.createDataFrame([
        ("a", "t1", 0, False, "h1", "Ann", "person", at(0), "rome rome paris"), (None, "t1", 1, True, None, None, None, at(1), "fine"),
        ("b", "t2", 0, False, "h2", "Bot", "bot", old, "news"),
    ], "person string, thread string, seq int, from_me boolean, handle string, name string, kind string, ts timestamp, text string")
    contacts = spark.createDataFrame([("h1", "Ann Known")], "handle string, name string")
    got = {r.person: r for r in messaging.personas(rows, contacts, spark.createDataFrame([], "person string, score double"), now).collect()}
    assert (got["a"].name, got["a"].tier, got["a"].cadence, got["a"].handles) == ("Ann Known", "relationship", "recent", ["h1"])
    assert got["a"].topics[0] == "rome"
    assert (got["b"].name, got["b"].tier, got["b"].cadence, got["b"].last_ts) == ("Bot", "unknown", "dormant", None)
