"""State, drains and chunks: replays, interruptions and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.functions.extract import turn_chunks
from memloom.operators import drains, health_state, retrieval
from memloom.session import complete_parts, shared_path

FACT = "ts timestamp, entities array<string>, anchors array<string>, valence double, episodicity double, versions map<string,string>"


def fact_rows(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [
        (None if rng.random() < 0.1 else f"2024-01-{rng.randint(1, 28):02d} 10:00:00", rng.choice([None, [], ["a"], ["a", "b"]]), rng.choice([None, [], ["x"]]), rng.choice([None, 0.5]), None, rng.choice([None, {}, {"e": "v1"}, {"e": None, "t": "v2"}]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, FACT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def flat(df):
    return sorted(map(str, df.collect()))


def test_replays_and_compaction_add_nothing(spark):
    path, rows = shared_path(spark, "t"), [fact_rows(spark, seed=s) for s in range(3)]
    whole = health_state.memory_days(rows[0].union(rows[1]).union(rows[2])).groupBy("role", "day", "metric", "key").agg(F.sum("value").alias("value"))
    today = F.lit("2024-01-28").cast("date")
    assert health_state.read(spark, path).collect() == []
    for batch in (0, 1, 0, 1, 2):
        health_state.add_batch(health_state.memory_days(rows[batch]), path, batch)
        health_state.compact(spark, path, today)
    assert complete_parts(spark, path, "base") == [0, 1, 2]
    assert flat(health_state.read(spark, path)) == flat(whole)
    health_state.add_batch(health_state.memory_days(rows[2]), path, 2)  # a replay after compaction
    assert flat(health_state.read(spark, path)) == flat(whole)
    late = F.lit("2024-02-10").cast("date")
    health_state.add_batch(health_state.memory_days(rows[0].limit(0)), path, 3)
    health_state.compact(spark, path, late, keep=20)
    assert min(r["day"].isoformat() for r in health_state.read(spark, path).collect()) >= "2024-01-22"


def test_a_stream_that_restarts_equals_one_run(spark, tmp_path):
    src, path = str(tmp_path / "in"), shared_path(spark, "t")
    schema = fact_rows(spark).schema
    for k in range(2):
        fact_rows(spark, seed=k).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        health_state.fold_stream(stream, path, str(tmp_path / "checkpoint"), health_state.memory_days).awaitTermination()
    assert len(complete_parts(spark, path, "batch")) == 2
    whole = health_state.memory_days(fact_rows(spark, seed=0).union(fact_rows(spark, seed=1))).groupBy("role", "day", "metric", "key").agg(F.sum("value").alias("value"))
    assert flat(health_state.read(spark, path)) == flat(whole)


def test_levels(spark):
    day = lambda n, m, key, value: ("memory", f"2024-01-{n:02d}", m, key, float(value))
    rows = [day(5, "rows", "", 100), day(30, "rows", "", 100), day(5, "valence", "", 50), day(30, "valence", "", 44), day(5, "anchors", "", 50), day(30, "anchors", "", 40), day(5, "entities", "", 50), day(30, "entities", "", 45),
            day(5, "entity_tokens", "", 100), day(30, "entity_tokens", "", 89), day(5, "version:e", "v1", 9), day(30, "version:e", "v2", 9), day(30, "version:e", "", 9), day(5, "version:t", "v1", 1), day(30, "version:t", "v1", 1)]
    state = spark.createDataFrame(rows, "role string, day string, metric string, key string, value double").withColumn("day", F.col("day").cast("date"))
    made = {r["metric"]: r["level"] for r in health_state.report(state, F.lit("2024-01-31").cast("date")).collect()}
    assert made == {"valence": "warn", "anchors": "critical", "entities": "ok", "entity_tokens": "warn", "version:e": "bump", "version:t": "ok"}


def test_a_version_drains_once_over_broken_runs(spark):
    path = shared_path(spark, "t")
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("x")).union(spark.createDataFrame([(None, 1)], "id long, x long"))
    schema, calls = "id long, y long, digest string, changed boolean", []

    def features(part):
        calls.append(1)
        return part.select("id", (F.col("x") + 1).alias("y"))

    def broken(part):
        made = features(part)
        return made.withColumn("y", F.when(F.col("y") > 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("y"))) if len(calls) > 5 else made

    first = drains.backfill(rows, path, 1, features, 20, most_batches=2)
    assert first == {"written": 2, "left": True}
    with pytest.raises(Exception, match="lost"):
        drains.backfill(rows, path, 1, broken, 20)
    again = drains.backfill(rows, path, 1, features, 20)
    assert not again["left"] and again["written"] <= 3
    got = drains.done(spark, path, 1, schema).collect()
    assert sorted(r["id"] for r in got) == list(range(100)) and all(r["changed"] for r in got)
    assert drains.backfill(rows, path, 1, features, 20) == {"written": 0, "left": False}
    more = rows.union(spark.createDataFrame([(500, 3)], "id long, x long"))  # rows that came later
    assert drains.backfill(more, path, 1, features, 20)["written"] == 1
    drains.backfill(more, path, 2, lambda p: p.select("id", (F.col("x") + F.when(F.col("id") < 10, 2).otherwise(1)).alias("y")), 50)
    assert sorted(r["id"] for r in drains.done(spark, path, 2, schema).where("changed").collect()) == list(range(10))
    last = {r["id"]: (r["version"], r["y"]) for r in drains.latest(spark, path, schema).collect()}
    assert len(last) == 101 and last[3] == (2, 5) and last[500] == (2, 4)
    with pytest.raises(ValueError, match="no row"):
        drains.drain(rows, shared_path(spark, "t"), 1, lambda p: p.where("id < 5"), 50)


def plain_chunks(text, window, overlap):
    if not text:
        return []
    segs = [text]
    for mark in ("\n---\n", "\n\n## "):
        if mark in text:
            parts = text.split(mark)
            segs = [s for s in [parts[0], *(mark + p for p in parts[1:])] if s]
            break
    segs = [s[i : i + window] for s in segs for i in range(0, len(s), window)]
    out, cur = [], ""
    for seg in segs:
        if not cur or len(cur) + len(seg) <= window:
            cur += seg
            continue
        out.append(cur)
        cur = (cur[-overlap:] if overlap else "") + seg
        while len(cur) > window:
            out.append(cur[:window])
            cur = cur[window - overlap :]
    return [*out, cur]


@pytest.mark.parametrize(("window", "overlap"), [(20, 0), (20, 7), (9, 4), (1000, 100)])
def test_chunks_equal_a_plain_loop(spark, window, overlap):
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "é", "longer words here", "\n---\n", "\n\n## ", "\n---\n", "x" * 25, ""])
    texts = ["".join(word() for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", "\n---\n", "## a\n\n## b" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = {}
    for r in retrieval.chunk_rows(docs, window, overlap).collect():
        made.setdefault(r["id"], {})[r["chunk"]] = r["text"]
    for k, t in enumerate(texts):
        want = plain_chunks(t, window, overlap)
        assert made.get(k, {}) == ({str(k): want[0]} if len(want) == 1 else {f"{k}#{i}": w for i, w in enumerate(want)}), repr(t)
    with pytest.raises(ValueError):
        turn_chunks(F.col("text"), 10, 6)


def test_best_chunks(spark):
    rows = [("a#0", 0.5), ("a#1", 0.7), ("a#2", 0.7), ("b", None), ("c#x", 0.1), ("#3", 0.2), ("d#1#2", 0.3), ("d#1", 0.2)]
    made = sorted(map(tuple, retrieval.best_chunks(spark.createDataFrame(rows, "chunk string, score double")).collect()))
    assert made == [("#3", "#3", 0.2), ("a", "a#1", 0.7), ("b", "b", None), ("c#x", "c#x", 0.1), ("d", "d#1", 0.2), ("d#1", "d#1#2", 0.3)]
