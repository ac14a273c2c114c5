"""Cycles, people, contradictions, engagement and message stores on small fixtures."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from memloom.operators import engagement, evaluation, graph, identity, reconcile
from memloom.sources import mailbox


def _simple_cycles(edges, most):
    found, out = set(), {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def walk(path):
        for n in out.get(path[-1], ()):
            if n == path[0]:
                found.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < most:
                walk([*path, n])

    for a in out:
        walk([a])
    return found


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 1), (3, 2), (3, 4), (4, 5), (6, 1), (7, 7), (5, 4)],
    [(i, (i * i + 1) % 23) for i in range(23)] + [(i, (i * 3 + 2) % 23) for i in range(23)],
    [(1, 2), (2, 3)],
    [],
])
def test_cycles(spark, edges):
    rows = spark.createDataFrame([*edges, *edges[:1], (None, 1)], "child long, parent long")
    for most in (2, 5):
        assert sorted(tuple(r.nodes) for r in graph.cycles(rows, most).collect()) == sorted(_simple_cycles(edges, most))


def test_propagation_stops_at_facts(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("c", "e"), ("e", "r")], "child string, parent string")
    kinds = spark.createDataFrame([("b", "fact"), ("a", "reconstructed")], "id string, kind string")
    got = graph.propagate_up(edges, kinds, spark.createDataFrame([("r",), ("r",)], "id string"))
    assert sorted((r.id, r.depth, r.weight) for r in got.collect()) == [("a", 1, 1.0), ("b", 1, 1.0), ("c", 2, 0.5), ("e", 3, 0.25)]


def test_people_by_union_find(spark):
    rows = [(f"u{i}", str(i * 7 % 31 // 2)) for i in range(40)] + [(f"u{i}", f"x{i // 4}") for i in range(0, 40, 3)] + [("lone", None), ("lone", None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for m, i in rows:
        if i is not None:
            root[find("i" + i)] = find(m)
    own = find("i3")
    got = {r.member: r.person for r in identity.people(spark.createDataFrame(rows, "member string, identifier string"), spark.createDataFrame([("3",)], "identifier string")).collect()}
    assert set(got) == {m for m, _ in rows}
    for a in got:
        assert (got[a] == identity.OPERATOR) == (find(a) == own)
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    none = spark.createDataFrame([], "member string, identifier string")
    assert identity.people(none, none.select("identifier")).count() == 0


def test_identifiers(spark):
    raw = ["Ann@X.org ", "+44 20-7946 0000", "12", "words", None]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(identity.identifier(F.col("raw")).alias("i"))
    assert [r.i for r in rows.collect()] == ["email:ann@x.org", "phone:+442079460000", None, None, None]


@pytest.mark.parametrize("turn, memory, told", [
    ("please forget that trip", "the trip to rome", "dismiss"),
    ("forget that one", "rome", "no_engagement"),
    ("no, rome was the plan", "we fly to rome", "correction"),
    ("no a b c d e f rome", "rome oslo", "no_engagement"),
    ("no a b c d e f rome", "rome", "paraphrase"),
    ("no a b c d e rome", "rome", "correction"),
    ("so we fly to oslo", "then we fly to rome", "direct"),
    ("oslo to fly", "fly oslo", "paraphrase"),
    ("fly", "", "no_engagement"),
    ("  ", "fly", None),
    (None, "fly", None),
])
def test_engagement(spark, turn, memory, told):
    rows = spark.createDataFrame([(turn, memory)], "t string, m string").select("t", engagement.words(F.col("t")).alias("u"), engagement.words(F.col("m")).alias("w"))
    got = rows.select(engagement.engagement(F.col("t"), F.col("u"), F.col("w")).alias("e")).first().e
    assert (got and got["class"]) == told


ROW = "id string, thread string, kind string, entities array<string>, sign int, magnitude double, embedding array<double>, scope string, agent string, confidence double"


def test_contradictions_and_resolution(spark):
    new = spark.createDataFrame([("n", "t1", "reconstructed", ["a", "b"], 1, 0.5, [1.0, 0.0], "s", "bot:2", 0.9), ("m", "t1", "reconstructed", ["z"], None, None, None, "s", "bot:2", 0.9)], ROW)
    rows = spark.createDataFrame([
        ("p", "t1", "fact", ["a"], 1, 0.9, [1.0, 0.0], "s", "bot:1", 0.5),
        ("near", "t1", "reconstructed", ["a"], -1, 0.9, [1.0, 0.0], "s", "bot:1", 0.5),
        ("sign", "t2", "reconstructed", ["a"], -1, 0.1, [1.0, 0.0], "s", "bot:1", 0.5),
        ("away", "t2", "reconstructed", None, None, None, [-1.0, 0.2], "s", "bot:1", 0.5),
        ("fact", "t2", "fact", ["a"], -1, 1.0, [-1.0, 0.0], "s", "bot:1", 0.5),
    ], ROW)
    edges = spark.createDataFrame([(c, "p") for c in ("n", "near", "sign", "away", "fact", "gone")] + [("m", "p"), ("m", "unknown")], "child string, parent string")
    found = reconcile.contradictions(new, rows, edges)
    assert sorted((r.id, r.other, r.relation, r.test) for r in found.collect()) == [
        ("m", "near", "sibling", "refines"), ("n", "away", "sibling", "cosine"), ("n", "near", "sibling", "refines"), ("n", "sign", "sibling", "valence"),
    ]
    policy = "id string, kind string, confidence double, active boolean, entities array<string>"
    none = reconcile.forbidden(new, spark.createDataFrame([("x", "exclude", 0.8, True, ["z"]), ("y", "exclude", 0.9, False, ["z"])], policy))
    got = {r.id: (r.resolution, r.superseded) for r in reconcile.resolution(new, rows, found, none).collect()}
    assert got == {"n": ("co_exist", None), "m": ("substitute", "near")}
    barred = reconcile.forbidden(new, spark.createDataFrame([("x", "exclude", 0.9, None, ["z", "z"])], policy))
    got = {r.id: r.resolution for r in reconcile.resolution(new, rows, found, barred).collect()}
    assert got == {"n": "co_exist", "m": "exclude_rejected"}


def test_sibling_bound(spark):
    new = spark.createDataFrame([(0,)], "id long")
    edges = spark.createDataFrame([(0, 100), (0, 101)] + [(i, 100) for i in range(1, 31)] + [(i, 101) for i in range(25, 60)], "child long, parent long")
    got = reconcile.candidates(new, edges)
    assert sorted(r.other for r in got.where("relation = 'sibling'").collect()) == list(range(1, 33))
    assert sorted(r.other for r in got.where("relation = 'parent'").collect()) == [100, 101]


def test_gates(spark):
    points = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.6, 0.3), (2, 0.6, 0.1), (3, 0.6, 0.1), (4, None, 0.0), (5, float("nan"), 0.0)], "iteration int, ndcg double, harm double")
    assert [r.iteration for r in evaluation.best_weights(points, 0.1).collect()] == [2]
    assert evaluation.best_weights(points, -1.0).count() == 0
    empty = spark.createDataFrame([], "ts timestamp")
    assert evaluation.weekly_volume(empty).first().volume == 0


def _mail():
    m = EmailMessage()
    m["From"], m["To"], m["Cc"], m["Subject"], m["Message-ID"] = "Ann <Ann@X.org>", "b@x.org, c@x.org", "d@x.org", "Grüße", "<1@x>"
    m.set_content("Hallo Müller\nzwei\n")
    m.add_alternative("<p>Hallo <b>M&uuml;ller</b></p>", subtype="html")
    return bytes(m)


def test_mail_bodies(spark):
    raw = _mail()
    emlx = str(len(raw)).encode() + b"\n" + raw + b"<?xml version='1.0'?><plist/>"
    html = b"Subject: s\nContent-Type: text/html; charset=nonsense\n\n<style>x</style><p>one</p><p>two&amp;</p>"
    rows = spark.createDataFrame([(0, raw), (1, emlx), (2, None), (3, b""), (4, html)], "id int, raw binary")
    got = {r.id: r.m for r in rows.select("id", mailbox.decode_mail(F.col("raw")).alias("m")).collect()}
    for i in (0, 1):
        assert (got[i].sender, got[i].recipients, got[i].copied, got[i].subject, got[i].body) == ("ann@x.org", ["b@x.org", "c@x.org"], ["d@x.org"], "Grüße", "Hallo Müller\nzwei")
    assert got[2] is None and got[3].body == "" and got[3].sender is None
    assert got[4].body.split() == ["one", "two&"] and got[4].defects == 1


def test_message_stores(spark):
    frame = spark.createDataFrame
    message = frame([(1, 1, 0, 0, "a"), (2, 1, 86400, 0, "b"), (3, None, 86400 * 10**9, 1, "c")], "row_id long, handle_id long, date long, is_from_me int, text string")
    chats = mailbox.chat_messages(message, frame([(1, "+1")], "row_id long, address string"), frame([(1, 5), (2, 5), (2, 9)], "message_id long, chat_id long"), frame([(5, "g5")], "row_id long, guid string"), after=1)
    assert sorted((r.row_id, str(r.ts), r.sender, r.thread, r.thread_messages) for r in chats.collect()) == [(2, "2001-01-02 00:00:00", "+1", "g5", 2), (3, "2001-01-02 00:00:00", "me", None, 0)]
    mail = mailbox.mail_messages(
        frame([(1, 1, 1, 1, 0), (2, None, None, None, 5)], "row_id long, sender long, subject long, mailbox long, date long"), frame([(1, "a"), (2, "b"), (3, "c")], "row_id long, address string"),
        frame([(1, "hi")], "row_id long, subject string"), frame([(1, "in")], "row_id long, url string"), frame([(1, 3, 0, 1), (1, 2, 0, 0), (1, 1, 1, 0)], "message long, address long, type int, position int"),
    )
    assert sorted((r.row_id, r["from"] or "", r.subject or "", r.folder or "", r.to, r.cc) for r in mail.collect()) == [(1, "a", "hi", "in", ["b", "c"], ["a"]), (2, "", "", "", [], [])]
    talk = mailbox.session_messages(
        frame([(1, 1, None, None, 0, 0, "q"), (2, 1, 7, 1, 0, 0, "r"), (3, 1, None, 2, 1, 0, "s")], "pk long, session long, member long, parent long, from_me int, date long, text string"),
        frame([(1, "grp")], "pk long, jid string"), frame([(7, "m7")], "pk long, jid string"),
    )
    assert sorted((r.pk, r.sender, r.quoted or "") for r in talk.collect()) == [(1, "grp", ""), (2, "m7", "q"), (3, "me", "r")]
    book = mailbox.address_book(frame([(1, "A", None, None), (2, None, None, "Org")], "pk long, first string, last string, organisation string"), frame([(1, "1")], "owner long, number string"), frame([(2, "X@Y")], "owner long, address string"))
    assert sorted(tuple(r) for r in book.collect()) == [("A", "1", "phone"), ("Org", "x@y", "email")]
    logs = mailbox.turns(frame([("s", 0, "assistant", "z"), ("s", 1, "user", "q"), ("s", 2, "assistant", "a"), ("s", 3, "assistant", "b"), ("s", 4, "user", "r")], "session string, seq int, role string, text string"))
    assert sorted(tuple(r) for r in logs.collect()) == [("s", 0, "", "z"), ("s", 1, "q", "a\nb"), ("s", 2, "r", "")]
