"""Health, graded evaluation, policies and the catch-up order, by hand-worked cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import extract
from memloom.operators import evaluation, messaging, monitoring, policies

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_graded_gains(spark):
    surfaced = spark.createDataFrame([(1, i + 1, i) for i in range(4)] + [(2, 1, 9)], "event long, rank int, id long")
    labels = [(1, 0, "expected"), (1, 0, "forbidden"), (1, 1, "expected"), (1, 2, "neighbour"), (1, 1, "neighbour"), (1, 7, "expected"), (2, 9, "forbidden"), (3, 5, "expected")]
    got = {r.event: r for r in evaluation.graded(surfaced, spark.createDataFrame(labels, "event long, id long, role string")).collect()}
    dcg = -2 + 2 / math.log2(3) + 1 / 2
    assert got[1].ndcg == pytest.approx(dcg / (2 + 2 / math.log2(3) + 2 / 2 + 1 / math.log2(5))) and got[1].harm
    assert got[2].ndcg is None and got[2].harm and got[3].ndcg == 0.0 and not got[3].harm


def test_failure_rates_count_misses(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("a", 19), ("a", 20), ("a", None)], "leg string, rank int")
    assert tuple(evaluation.failure_rates(rows).first())[1:] == pytest.approx((5, 0.4, 0.2, 0.4, 0.6))


@pytest.mark.parametrize(
    "change, applied",
    [({}, "b"), ({"reviewed": None}, None), ({"cold_start": True}, None), ({"harm_delta": 0.1}, None), ({"ndcg_delta": 0.0}, None), ({"ndcg_delta": math.nan}, None), ({"headroom": False}, None), ({"w": math.inf}, None)],
)
def test_only_the_latest_weights_count(spark, change, applied):
    last = {"id": "b", "ts": "2024-01-02", "reviewed": True, "cold_start": None, "harm_delta": 0.0, "ndcg_delta": 0.1, "headroom": None, "w": 0.5}
    rows = [last | {"id": "a", "w": 0.9}, last | {"ts": None, "id": "z", "w": 0.8}, last | change]
    ddl = "id string, ts string, reviewed boolean, cold_start boolean, harm_delta double, ndcg_delta double, headroom boolean, w double"
    got = evaluation.weight_overlay(spark.createDataFrame([tuple(r.values()) for r in rows], ddl), {"w": 0.25}).collect()
    assert [tuple(r) for r in got] == [(0.5 if applied else 0.25, applied)]
    assert evaluation.weight_overlay(spark.createDataFrame([], ddl), {"w": 0.25}).collect()[0].w == 0.25


def test_day_parts_merge(spark):
    rows = [("a", at(30, h), h == 1, float(h)) for h in range(4)] + [("a", at(29), None, None), ("a", None, True, 9.0), ("b", at(1), False, 1.0)]
    frame = spark.createDataFrame(rows, "source string, ts timestamp, blank boolean, value double")
    whole = monitoring.day_partials(frame)
    parts = monitoring.day_partials(frame.where("value < 2")).unionByName(monitoring.day_partials(frame.where("value >= 2 or value is null")))
    today = F.lit("2024-01-30").cast("date")
    for days in (whole, parts):
        assert {tuple(r) for r in monitoring.merge_days(days, today).collect()} == {("a", 2, 5, 1, 6.0, 3.0), ("b", 1, 1, 0, 1.0, 1.0)}


def test_alerts_and_lags(spark):
    rows = spark.createDataFrame([("a", "DROP")] * 100 + [("b", "DROP")] * 99 + [("c", "PASS")] + [("c", None)] * 200, "source string, decision string")
    assert {r.source: r.alert for r in monitoring.funnel_alert(rows).collect()} == {"a": True, "b": False, "c": False}
    seen = spark.createDataFrame([("a", at(30, 19)), ("b", at(30, 1)), ("c", at(30, 1)), ("d", None)], "source string, ts timestamp")
    assert {r.source: r.stale for r in monitoring.capture_staleness(seen, now(), {"c": 24}).collect()} == {"a": False, "b": True, "c": False, "d": None}
    tails = spark.createDataFrame([("a", at(30), None), ("b", at(30), at(1)), ("c", at(30), at(30, 23)), ("d", None, None)], "source string, tail_ts timestamp, modified timestamp")
    cursors = spark.createDataFrame([("a", at(28)), ("b", at(28)), ("d", at(1))], "source string, cursor_ts timestamp")
    assert {r.source: (r.lag_ms, r.warned) for r in monitoring.cursor_lag(tails, cursors, now()).collect()} == {"a": (172_800_000, True), "b": (172_800_000, False), "c": (None, False), "d": (None, False)}


def test_empty_inputs(spark):
    assert monitoring.liveness(spark.createDataFrame([], "found boolean")).first().verdict == "inconclusive"
    assert tuple(monitoring.hostname_dominance(spark.createDataFrame([], "matched boolean")).first()) == (0, 0, 0.0, False)
    none = spark.createDataFrame([], "id long")
    assert tuple(monitoring.index_coverage(none, none, 0.9).first()) == (0, 0, 0.0, False)
    assert monitoring.embed_cost(spark.createDataFrame([], "ts timestamp, model string, source string, tokens long, price double")).collect() == []


def test_predicates_withdrawn_once_and_for_all(spark):
    rows = [(1, 10, "exclude", 1), (1, 10, "rescind", 2), (1, 10, "rescind", 3), (2, 5, "exclude", 4), (3, 7, "exclude", 5), (4, 0, "rescind", 6)]
    active = policies.active_predicates(spark.createDataFrame(rows, "predicate_id long, captured_at long, action string, seq long"))
    assert [tuple(r) for r in policies.list_predicates(active, 1).collect()] == [(2, 5, 2, True)]
    assert [r.predicate_id for r in policies.list_predicates(active).orderBy("captured_at").collect()] == [2, 3]


def test_gate_overlay_and_revocation(spark):
    rows = [(1, "reconstructed", [7, 8]), (2, "reconstructed", [7, 9]), (3, "fact", [7]), (4, "reconstructed", []), (5, "reconstructed", [None]), (6, None, None)]
    made = spark.createDataFrame(rows, "id long, kind string, parents array<long>")
    gate = policies.derivation_gate(made, spark.createDataFrame([(7,), (8,)], "id long"))
    assert {r.id: r.gate for r in gate.collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0}
    facts = spark.createDataFrame([(1, 0.1, "x"), (2, 0.2, "y")], "id long, v double, t string")
    fills = spark.createDataFrame([(1, 2, "b", 1, 0.9, None), (1, 1, "z", 9, 0.5, "old")], "target long, version long, ts string, id long, v double, t string")
    assert {tuple(r) for r in policies.overlay(facts, fills, ["v", "t"]).collect()} == {(1, 0.9, "x"), (2, 0.2, "y")}
    refs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, None)], "id long, source_refs array<string>")
    assert [tuple(r) for r in policies.revoked_ids(refs, spark.createDataFrame([("a",), ("b",)], "source_ref string")).collect()] == [(1,)]


def test_catchup_order_by_tier_contact_score_time_thread(spark):
    rows = [("t1", "unknown", True, 9.0, at(5)), ("t2", "relationship", False, 5.0, at(5)), ("t3", "relationship", True, None, None), ("t4", "relationship", True, -1.0, at(1)),
            ("t5", "relationship", True, math.nan, at(1)), ("t6", None, None, 1.0, at(9))]
    frame = spark.createDataFrame(rows, "thread string, tier string, contact boolean, score double, ts timestamp")
    assert [r.thread for r in messaging.catchup_order(frame).collect()] == ["t4", "t5", "t3", "t2", "t1", "t6"]
    score = messaging.catchup_score(F.col("ts"), now(), F.lit(0.5), F.lit(1.0), F.col("a"))
    got = spark.createDataFrame([(at(31), 0.5), (at(31), 1.2), (None, 1.0), (dt.datetime(2024, 1, 27, 12), 1.0)], "ts timestamp, a double").select(score.alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([0.5, 0.6, 0.025, 0.5 * (0.05 + 0.95 * 0.5)])


def test_unanswered_messages_lower_reciprocity(spark):
    rows = spark.createDataFrame([(2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0), (4, 4, 4), (9, 9, 6)], "i long, o long, t long")
    got = [r.f for r in rows.select(messaging.reciprocity_factor(F.col("i"), F.col("o"), F.col("t")).alias("f")).collect()]
    assert got == pytest.approx([0.7, 0.46, 0.38, 0.3, 0.85, 1.0])


def test_noise_entities(spark):
    keys = ["person:user", "person:ann", "topic:00000000_0000_4000_8000_00000000000A", "topic:user", "user", "", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.n for r in rows.select(extract.noise_entity(F.col("k")).alias("n")).collect()] == [True, False, True, False, False, False, False]
