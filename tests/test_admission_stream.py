"""Stateful admission over micro-batches and restarts against the batch operators."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.operators import events
from memloom.streaming import admission as live

SCHEMA = "id long, ts timestamp, template string, sender string, handle string, hash string"
HOUR = 3_600_000_000


def made_rows(seed, n=240):
    rng = random.Random(seed)
    at = sorted(rng.randint(0, 72 * 3600) for _ in range(n))
    return [(k, 1_700_000_000 + t, rng.choice(["hello", "code", None]), rng.choice("ab"), rng.choice("xyz"), rng.choice(["h1", "h2", "h3"])) for k, t in enumerate(at)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


def streamed(spark, tmp_path, parts, operator):
    """Each part is one run of the stream, which goes on from its checkpoint in a new query."""
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame(spark, part).schema).parquet(src)
        query = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        last = query.lastProgress
    return spark.read.parquet(out), last


@pytest.fixture(scope="module")
def rows():
    return made_rows(3)


def cuts(rows):
    return [rows[:50], rows[50:51], rows[51:150], rows[150:]]


def test_rolling_template(spark, tmp_path, rows):
    got, _ = streamed(spark, tmp_path, cuts(rows), lambda s: live.rolling_template(s, 6 * HOUR, 3))
    want = events.rolling_template(frame(spark, rows).select("id", "template", "sender", F.unix_micros("ts").alias("at")), 6 * HOUR, 3)
    assert sorted(map(tuple, got.select("id", "n_window", "drop").collect())) == sorted(map(tuple, want.select("id", "n_window", "drop").collect()))


def test_burst_collapse(spark, tmp_path, rows):
    got, _ = streamed(spark, tmp_path, cuts(rows), lambda s: live.burst_collapse(s, HOUR))
    want = events.burst_collapse(frame(spark, rows).select("id", "handle", F.unix_micros("ts").alias("at")), HOUR)
    assert sorted(map(tuple, got.select("id", "keep").collect())) == sorted(map(tuple, want.select("id", "keep").collect()))


def test_seen_hash_and_expiry(spark, tmp_path, rows):
    got, last = streamed(spark, tmp_path, [*cuts(rows), [(9999, 1_700_000_000 + 40 * 86400, "t", "a", "x", "h9")], [(10000, 1_700_000_000 + 80 * 86400, "t", "a", "x", "h9")]], live.seen_in_day)
    day = F.date_format("ts", "yyyy-MM-dd")
    first = F.row_number().over(Window.partitionBy("hash", day).orderBy("ts", "id")) == 1
    want = frame(spark, rows).withColumn("first", first).select("id", "first").collect()
    assert sorted(map(tuple, got.where("id < 9999").select("id", "first").collect())) == sorted(map(tuple, want))
    assert last["stateOperators"][0]["numRowsTotal"] <= 2  # old days are gone


def test_ids_and_times_that_are_missing_are_left_out(spark, tmp_path):
    odd = [(None, 1_700_000_000, "t", "a", "x", "h"), (1, None, "t", "a", "x", "h"), (2, 1_700_000_000, None, None, None, None), (3, 1_700_000_000, None, None, None, None)]
    got, _ = streamed(spark, tmp_path, [odd], lambda s: live.burst_collapse(s, HOUR))
    assert sorted(map(tuple, got.select("id", "keep").collect())) == [(2, True), (3, False)]
