"""Turns of sessions and bodies of messages against plain Python."""

import json
import random

import pytest

from memloom.functions import archive
from memloom.sources import sessions


def paired(rows):
    """Rows (seq, ts, role, text) of one session in order."""
    turns, user, devs, last = [], None, [], None
    for _, ts, role, text in rows:
        last = ts or last
        if role == "developer":
            if text:
                devs.append(text)
        elif role == "user":
            if user:
                turns.append([user[1] or last, user[0], "", devs])
            user = (text or "", ts)
        elif role == "assistant":
            turns.append([ts or (user and user[1]) or last, user[0] if user else "", text or "", devs])
            user, devs = None, []
    if user:
        turns.append([user[1] or last, user[0], "", devs])
    return turns


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_turns(spark, partitions):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        rows.append((rng.choice([0, 0, 0, 1, 2]), k, rng.choice([None, f"t{k:04d}"]), rng.choice(["user", "user", "assistant", "assistant", "developer", "tool"]), rng.choice(["", None, f"said {k}"])))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows + [(None, 1, "t", "user", "x")], "session long, seq long, ts string, role string, text string").repartition(5)
        got = {}
        for r in sessions.pair_turns(frame).orderBy("session", "turn_index").collect():
            assert r["turn_index"] == len(got.setdefault(r["session"], []))
            got[r["session"]].append([r["ts"], r["user_text"], r["assistant_text"], r["developer_texts"]])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {s: paired([r[1:] for r in rows if r[0] == s]) for s in (0, 1, 2)}


def test_log_lines(spark):
    """A session's meta line and events are no messages; empty turns still count."""
    say = lambda role, *texts: ("response_item", {"type": "message", "role": role, "content": [{"type": "input_text", "text": t} for t in texts] + [{"type": "image"}]})
    lines = [("session_meta", {"id": "s"}), ("event_msg", {"type": "task_started"}), say("developer", "rules"), say("user", "context"), say("user", "do", "", "it"), say("assistant", "done"), say("user", ""), say("assistant", ""),
             ("response_item", {"type": "message", "role": "user", "content": "plain"}), ("response_item", {"type": "reasoning"})]
    rows = [("s", k, f"t{k}", kind, json.dumps(p)) for k, (kind, p) in enumerate(lines)]
    made = sessions.pair_turns(sessions.messages(spark.createDataFrame(rows, "session string, seq long, timestamp string, type string, payload string"))).orderBy("turn_index").collect()
    assert [tuple(r)[1:] for r in made] == [(0, "t3", "context", "", ["rules"]), (1, "t5", "do\n\nit", "done", ["rules"]), (2, "t7", "", "", []), (3, "t8", "plain", "", [])]


def body(text, frame=b"\x84", size=None):
    raw = text if isinstance(text, bytes) else text.encode()
    n = size if size is not None else bytes([len(raw)]) if len(raw) < 0x81 else b"\x81" + len(raw).to_bytes(2, "little") if len(raw) < 65536 else b"\x82" + len(raw).to_bytes(4, "little")
    return b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSAttributed" + b"\x01+\x85" + frame + b"\x01+" + n + raw + b"\x86\x84\x02iI"


def test_bodies(spark):
    good = ["a", "ä" * 64, "x" * 0x80, "x" * 0x81, "long é" * 30_000, "with \x01+ inside \x84"]
    rows = [(k, body(t)) for k, t in enumerate(good)] + [(10, body("b", b"\x95")), (11, body("four", size=b"\xff\x04\x00\x00\x00"))]
    odd = {
        20: (None, "empty"), 21: (b"", "empty"), 22: (b"\x04\x0bstreamtypeX" + body("a")[13:], "header"), 23: (body("a", b"\x83"), "no_start"), 24: (body("", size=b"\x00"), "length"), 25: (body("a", size=b"\x90"), "length"),
        26: (body("a")[:-6] , "ok"), 27: (body("abc", size=b"\x50"), "out_of_bounds"), 28: (body(b"\xff\xfe"), "not_utf8"), 29: (body("a")[:38], "no_start"), 30: (body("a", size=b"\x81\x01")[:-8], "length"), 31: (body("x" * (1 << 20)), "oversized"),
    }
    frame = spark.createDataFrame(rows + [(k, b) for k, (b, _) in odd.items()], "id long, body binary")
    made = {r["id"]: r["decoded"] for r in archive.decode_bodies(frame).collect()}
    assert [made[k]["text"] for k in range(len(good))] == good and made[10]["text"] == "b" and made[11]["text"] == "four"
    assert {k: made[k]["state"] for k in odd if k != 26} == {k: s for k, (_, s) in odd.items() if k != 26}
    assert all(made[k]["text"] is None for k in odd if k != 26)
    counts = {r["state"]: r["n"] for r in archive.decode_counts(archive.decode_bodies(frame)).collect()}
    assert counts["empty"] == 2 and sum(counts.values()) == frame.count() and set(counts) <= set(archive.STATES)
