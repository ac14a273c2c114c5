"""Selection, evaluation and text functions on small frames, some against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import affect, extract
from memloom.operators import evaluation, graph, messaging, selection


def one(spark, made, ddl="t string", row=("x",)):
    return spark.createDataFrame([row], ddl).select(made.alias("v")).first()["v"]


def test_valence_has_sign_floor_and_bounds(spark):
    rows = spark.createDataFrame([("happy happy",), ("so sad today",), ("happy",), ("",), (None,), ("yes bad",)], "t string")
    found = [r["v"] for r in rows.select(affect.valence(F.col("t")).alias("v")).collect()]
    assert found[0] == 1.0 and found[1] == pytest.approx(-1 / np.sqrt(3)) and found[2:4] == [0.0, 0.0] and found[4] is None and found[5] == 0.0


def test_mood_of_the_closed_list(spark):
    rows = spark.createDataFrame([(" Angry",), ("calm",), ("odd",), (None,)], "t string")
    assert [r["v"] for r in rows.select(affect.mood_valence(F.col("t")).alias("v")).collect()] == [-0.8, 0.4, None, None]


def test_slug_strips_marks(spark):
    assert one(spark, extract.slug(F.col("t")), row=("  Žofie Müller-Ås! ",)) == "zofie_muller_as"


def test_entities_are_sorted_distinct_and_null_safe(spark):
    text = "mail a@b.org, a@b.org or https://x.org/q #tag-one"
    assert one(spark, extract.entities(F.col("t"), F.lit("s")), row=(text,)) == ["email:s:a_b_org", "topic:s:tag_one", "url:s:https_x_org_q"]
    assert one(spark, extract.entities(F.col("t"), F.lit("s")), row=(None,)) == []
    assert one(spark, extract.match_key(F.lit("email:s:a_b"))) == "email:a_b"


def test_time_anchors(spark):
    text = "Tomorrow, 3 days ago, in 2 weeks; March 5, 2024; 2024-13-01 is no date"
    found = one(spark, extract.time_anchors(F.col("t"), F.lit(dt.date(2024, 1, 31))), row=(text,))
    assert [r["day"] for r in found] == [dt.date(2024, 2, 1), dt.date(2024, 1, 28), dt.date(2024, 2, 14), dt.date(2024, 3, 5)]


@pytest.mark.parametrize("text", ["", "abc", "abcdefghij" * 7])
def test_chunks_cover_the_text(spark, text):
    found = [r["chunk"] for r in one(spark, extract.chunks(F.col("t"), 16, 4), row=(text,))]
    assert found[0] + "".join(c[4:] for c in found[1:]) == text and all(len(c) <= 16 for c in found)


def test_context_prefix_drops_from_the_tail(spark):
    names = F.array(*[F.lit(f"name{i}") for i in range(6)])
    line = one(spark, extract.context_prefix(F.lit("t"), F.lit("s"), names, F.lit("2024-01-01"), 70))
    assert len(line) <= 70 and "name0" in line and "name5" not in line
    assert "Entities" not in one(spark, extract.context_prefix(F.lit("t"), F.lit("s"), F.array().cast("array<string>"), F.lit("d")))


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(q, i, float(rng.random()), rng.normal(size=6).tolist()) for q in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "query long, id long, score double, embedding array<double>")
    made = {(r["query"], r["position"]): r["id"] for r in selection.mmr(df).collect()}
    for q in range(3):
        pool = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:15]
        unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in pool}
        chosen = []
        while len(chosen) < 12:
            gain = lambda r: 0.7 * r[2] - 0.3 * max([0.0] + [float(unit[r[1]] @ unit[c]) for c in chosen])  # noqa: E731, B023
            chosen.append(max((r for r in pool if r[1] not in chosen), key=gain)[1])
        assert [made[q, i] for i in range(12)] == chosen


def test_predicate_list_is_bounded(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>")
    assert {r["id"]: r["masked"] for r in selection.predicate_mask(rows, [[2.0, 0.0]]).collect()} == {1: True, 2: False, 3: False}
    assert not any(r["masked"] for r in selection.predicate_mask(rows, []).collect())
    with pytest.raises(ValueError):
        selection.predicate_mask(rows, [[1.0, 0.0]] * 1025)


def test_budget_keeps_the_last_item_in_part(spark):
    rows = spark.createDataFrame([("g", i, "x" * 5) for i in range(4)], "g string, pos long, content string")
    assert sorted((r["pos"], len(r["content"])) for r in selection.char_budget(rows, "g", 12, 5, 4).collect()) == [(0, 5), (1, 5), (2, 2)]


def test_bootstrap_interval_holds_the_mean_on_any_partitions(spark):
    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "id long, value double")
    a, b = (evaluation.bootstrap_ci(rows.repartition(n), 400).first() for n in (1, 5))
    assert a["mean"] == 4.5 and a["low"] < 4.5 < a["high"] and a["high"] - a["low"] < 1
    assert a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])


def test_metrics_of_events_without_relevant_rows_are_null(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "event long, rank int, relevant boolean")
    found = {r["event"]: r for r in evaluation.metrics(rows, 2).collect()}
    assert (found[1]["recall"], found[1]["rr"]) == (1.0, 0.5) and found[1]["ndcg"] == pytest.approx(1 / np.log2(3))
    assert found[2]["recall"] is None and found[2]["ndcg"] is None


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {i: i for pair in links for i in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    made = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {i: root(i) for i in up}


def test_orphans_end_and_rescue(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3)], "child long, parent long")
    seeds, kept = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(3,)], "id long")
    found = {r["id"]: (r["distance"], r["rescued"], r["factor"]) for r in graph.orphans(edges, seeds, kept).collect()}
    assert found[1] == (0, False, 0.05) and found[2] == (1, False, 0.5) and found[3] == (2, True, 1.0)
    assert found[4][0] == 3 and found[4][2] == pytest.approx(0.5 * np.exp(-0.8))


def test_a_dead_channel_gives_weight_to_the_live(spark):
    yes, no = F.lit(True), F.lit(False)
    score = lambda dm, first, said: one(spark, messaging.directedness(dm, said, first, yes, yes))
    all_live, all_said = dict.fromkeys(("addressed", "reply", "mention"), yes), dict.fromkeys(("addressed", "reply", "mention"), yes)
    assert score(no, all_live, all_said) == pytest.approx(1.0)
    assert score(no, all_live | {"addressed": no}, all_said) == pytest.approx(0.5 + 0.6 * 0.5)
    assert score(yes, dict.fromkeys(all_live, no), all_said) == 0.5
