"""Senders, paths, templates, and memories as they are shown."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions import senders
from memloom.operators import memories


def told(spark, function, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "yes", "no"),
    [
        (senders.is_shortcode, ["12345", " 123 ", "12-34", "(123)"], ["12", "1234567", "a123", "tel:123", "1@2", "", None]),
        (senders.is_business, ["urn:biz:x", "URN:business", "a@rbm.goog", "b@x.rcs.goog", "c@agent.rbm"], ["biz", "a@rbmx.com", "", None]),
        (senders.is_role, ["No-Reply@x.de", "info+tag@x", "alerts.bank1@x", "do_not_reply@x", "mailer-daemon.7@x", "Mailer-Daemon@x"], ["alice@x", "no.reply7@x", "@x", "info", "alerts.bank@x", "reply@x", "", None, "+news@x"]),
        (senders.is_bot, ["dependabot", "Renovate[bot]@x", "any[bot]@users", "29139614+renovate-bot@users.noreply", "web-flow@noreply", "claude[bot]"], ["robotics-fan", "bottom@example.com", "bots-r-us", "actions@github.com", "x+renovate-bot@y", "", None]),
        (senders.has_vendor_folder, ["/a/node_modules/b", "build\\x", "vendor"], ["/a/builder", "", None]),
        (senders.is_system_bundle, ["com.apple.dock", "com.apple.preference.x"], ["com.apple.Safari.x", "org.x", "", None]),
    ],
)
def test_shapes(spark, function, yes, no):
    assert told(spark, function, yes) == [True] * len(yes) and told(spark, function, no) == [False] * len(no)


def test_sender_kind_takes_any_handle(spark):
    rows = spark.createDataFrame([("alice@x", None, "urn:biz:1"), ("alice@x", "", None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(senders.sender_kind(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["service", None, None]


def test_paths(spark):
    rows = [("/a/dist/b", "r", True), ("com.apple.dock", "r", True), ("/a/b", "mirror", True), ("/a/b", "r", True), ("/a/b", "r", False), ("/a/b", None, None), ("", "r", True), (None, "r", True)]
    frame = spark.createDataFrame(rows, "p string, r string, own boolean")
    made = [r[0]["reason"] for r in frame.select(senders.path_verdict(F.col("p"), F.col("r"), ["mirror"], F.col("own"))).collect()]
    assert made == ["vendor_skip", "system_bundle", "allowlist_override", "classified_operator", "no_operator_commits", "unknown", "unknown", "unknown"]


def test_content_free(spark):
    schema = T._parse_datatype_string("a string, b string, n double, f boolean, l array<int>")
    rows = [(" ", None, 0.0, False, []), (None, None, None, None, None), ("x", None, 0.0, False, []), ("", "", float("nan"), False, None), ("", "", 1.0, False, []), ("", "", 0.0, True, []), ("", "", 0.0, False, [1])]
    of = lambda names: [(F.col(n), schema[n].dataType) for n in names]
    made = [r[0] for r in spark.createDataFrame(rows, schema).select(senders.content_free(of("ab"), of("nfl"))).collect()]
    assert made == [True, True, False, True, False, False, False]
    assert spark.range(1).select(senders.content_free([], [])).first()[0] is False


def test_template_hash(spark):
    def plain(t):
        if not t:
            return "0"
        h = 5381
        for c in t.strip().lower():
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    texts = ["Still waiting.", " still WAITING. ", "é ü", "", None, " ", "x" * 5000]
    assert told(spark, senders.template_hash, texts) == [plain(t) for t in texts]


def test_labels_meet_their_recall(spark):
    labels = spark.createDataFrame([("l1", ["r1", "r2"], "good"), ("l2", ["r9"], "bad"), ("l3", [], "bad"), ("l4", None, "x")], "id string, derived_from array<string>, verdict string")
    recalls = spark.createDataFrame([("r1", 3), ("r2", 4)], "id string, n int")
    made = memories.label_recalls(labels, recalls).collect()
    assert [(r["id"], r["recall"]["id"], r["recall"]["n"]) for r in made] == [("l1", "r1", 3)]


def test_aliases_of_entities(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "A", "a"]), (2, []), (3, None), (4, ["x", "b"])], "id long, entities array<string>")
    aliases = spark.createDataFrame([("A", "a"), ("b", "c"), ("b", "z"), ("c", "d")], "alias string, canonical string")
    made = {r["id"]: r["entities"] for r in memories.alias_entities(rows, aliases).collect()}
    assert made == {1: ["a", "c"], 2: [], 3: None, 4: ["x", "c"]}


def test_get(spark):
    ddl = "id long, kind string, content string, source string, ts timestamp, created_at timestamp, confidence double, source_refs array<struct<ref:string,via:string>>, derived_from array<long>, features struct<v:array<double>,w:array<int>,m:string>"
    rows = [(1, "fact", None, None, None, None, None, None, None, ([0.1] * 65, [1], "m")), (2, "reconstructed", "t", "mail", None, None, 0.5, [("a", None), ("b", "chat")], [1], None), (3, "reconstructed", "u", None, None, None, None, [], [1], None), (4, "fact", "v", None, None, None, None, [], [1], None)]
    ledger = spark.createDataFrame(rows, ddl)
    edges = spark.createDataFrame([(3, 1), (2, 1), (4, 1), (2, 1)], "child long, parent long")
    made = {r["id"]: r for r in memories.get(ledger, spark.createDataFrame([(1,), (2,), (9,)], "id long"), edges).collect()}
    assert set(made) == {1, 2} and made[1]["derived_into"] == [2, 3] and made[1]["content"] == "" and made[1]["provenance"]["source"] == "memory_ledger"
    assert made[1]["features"]["v"] is None and made[1]["features"]["w"] == [1] and made[1]["source_refs"] == []
    assert [tuple(x) for x in made[2]["source_refs"]] == [("a", "original"), ("b", "chat")] and made[2]["derived_into"] == []
