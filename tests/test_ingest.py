"""Ledgers, admission and the streams."""

import json

from pyspark.sql import functions as F

from memloom.operators import admission
from memloom.sources import ledger
from memloom.streaming import cascade


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def event(i, source="telegram", text="hello there", ts="2024-01-01T00:00:00Z"):
    return {"id": str(i), "ts": ts, "source": source, "source_msg_id": f"m{i}", "text": text, "raw": "{}"}


def test_scan_counts_broken_lines(spark, tmp_path):
    lines(tmp_path / "l" / "a.json", event(1), "{broken", event(2))
    rows = ledger.scan(spark, str(tmp_path / "l")).cache()
    assert ledger.tally(rows).first().asDict() == {"total": 3, "parsed": 2, "broken": 1}
    assert {r["id"] for r in ledger.parsed(rows).collect()} == {"1", "2"}


def test_append_seals_and_unseen_is_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "id string, text string")
    path = str(tmp_path / "ledger")
    ledger.append(rows.where("id = '1'"), path)
    had = ledger.scan(spark, path, "id string, text string, checksum string")
    assert len(had.first()["checksum"]) == 32
    fresh = ledger.unseen(rows, had, "id")
    assert [r["id"] for r in fresh.collect()] == ["2"]
    ledger.append(fresh, path)
    assert ledger.scan(spark, path, "id string, text string, checksum string").count() == 2


def test_windows_are_inclusive(spark):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'fact'), (2, timestamp'2024-01-02 00:00:00', 'policy') t(id, ts, kind)")
    assert {r["id"] for r in ledger.between(rows, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()} == {1, 2}
    assert {r["id"] for r in ledger.between(rows, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "fact").collect()} == {1}


def test_voice_notes_keep_orphans_once(spark):
    m = spark.createDataFrame([("t", "s1", None), ("t", "s2", "typed")], "thread string, stanza string, text string")
    v = spark.createDataFrame([("t", "s1", "said"), ("t", "s9", "lone"), ("t", "s9", "lone")], "thread string, stanza string, transcript string")
    assert sorted((r["stanza"], r["text"]) for r in ledger.voice_notes(m, v).collect()) == [("s1", "said"), ("s2", "typed"), ("s9", "lone")]


def verdicts(spark, ddl, *rows):
    return [(r["decision"], r["reason"], r["structural_score"]) for r in admission.admit(spark.createDataFrame(list(rows), ddl)).collect()]


def test_rules_go_in_order_and_nulls_fall_through(spark):
    found = verdicts(spark, "source string, text string, subject string, operator boolean, bot boolean, body string", ("git-log", None, "Merge branch x", False, True, None), ("git-log", None, "Merge branch x", True, False, None), ("git-log", None, "fix it", None, None, "why"), ("git-log", None, None, None, None, None))
    assert found == [("DROP", "merge_only", 0.0), ("PASS", None, 0.7), ("PASS", None, 0.85), ("PASS", None, 0.5)]


def test_each_source_drops_and_passes(spark):
    assert verdicts(spark, "source string, kind string, seconds double, text string", ("screentime", "usage", 2.0, None), ("screentime", "usage", 700.0, None)) == [("DROP", "micro_burst", 0.0), ("PASS", None, 0.65)]
    assert verdicts(spark, "source string, kind string, commits long, operator boolean", ("github-events", "WatchEvent", None, None), ("github-events", "PushEvent", 0, True), ("github-events", "PushEvent", 0, None)) == [("DROP", "low_signal_type", 0.0), ("PASS", "empty_push_own", 0.1), ("DROP", "empty_push", 0.0)]
    assert verdicts(spark, "source string, sender string, text string", ("imessage", "72345", "SALE! Reply STOP to end"), ("whatsapp", "447", "447"), (None, "a", "b")) == [("DROP", "shortcode_full", 0.0), ("DROP", "identifier_placeholder", 0.0), ("PASS", "unknown_source", 0.5)]


def test_restore_refuses_changed_rows(spark):
    rows = spark.createDataFrame([(1, "slack", " "), (2, "slack", "")], "id long, source string, text string")
    held = admission.quarantine(admission.admit(rows)).withColumn("text", F.when(F.col("id") == 2, "forged").otherwise(F.col("text")))
    back = admission.restore(held, held.select("id"))
    assert [r["id"] for r in back.collect()] == [1] and back.columns == rows.columns


def test_cascade_resumes_and_splits(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    lines(inbox / "a.json", event(1), event(2, "slack", " "), "{broken")
    run = lambda: cascade.cascade(cascade.watch(spark, str(inbox)), out, mark).awaitTermination()
    run()
    lines(inbox / "b.json", event(3, "mail", "Your login code is 123456"), event(4, "pigeon", "x"))
    run()
    read = lambda kind: {r["id"] for r in spark.read.parquet(f"{out}/{kind}").collect()}
    assert read("passed") == {"1", "4"} and read("held") == {"2", "3"}
    assert spark.read.parquet(f"{out}/broken").count() == 1


def streamed(spark, made, name):
    made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_throttle_counts_what_it_holds_back(spark, tmp_path):
    hour = 3_600_000_000
    for k, ats in enumerate([(0, 5, hour - 1), (hour, hour + 7), (3 * hour,)]):
        lines(tmp_path / "t" / f"{k}.json", *[{"source": "s", "reason": "r", "at": a} for a in ats])
    stream = spark.readStream.schema("source string, reason string, at long").json(str(tmp_path / "t"))
    found = sorted((r["at"], r["suppressed"]) for r in streamed(spark, cascade.throttle(stream), "throttled").collect())
    assert found == [(0, 0), (hour, 2), (3 * hour, 1)]


def test_once_drops_repeats(spark, tmp_path):
    lines(tmp_path / "o" / "a.json", event(1), event(1), event(2))
    stream = cascade.watch(spark, str(tmp_path / "o"))
    assert streamed(spark, cascade.once(stream, "source_msg_id"), "once").count() == 2
