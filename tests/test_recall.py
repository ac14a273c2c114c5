"""The recall plan and the decisions on incoming rows."""

import pytest
from pyspark.sql import functions as F

from memloom.operators import recall, salience


def test_recall_masks_damps_and_drops_copies(spark):
    facts = spark.createDataFrame(
        [(1, "alpha beta", "fact", 1.0), (2, "alpha  BETA", "fact", 1.0), (3, "alpha gamma", "fact", 1.0), (4, "alpha delta", "fact", 1.0), (5, "nothing", "fact", 1.0)],
        "id long, text string, kind string, age_days double",
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.6, 0.8])], "id long, embedding array<double>")
    recent = spark.createDataFrame([(4,)], "id long")
    found = {r["id"]: r for r in recall.recall(facts, vectors, ["alpha"], [1.0, 0.0], [[0.0, 1.0]], recent).collect()}
    assert set(found) == {1, 4}  # 2 is a copy of 1, 3 is masked, 5 is in no leg
    assert found[1]["position"] == 0 and found[1]["content"] == "alpha beta"
    plain = 0.6 + 0.7 + 0.3 * 2**-0.15
    assert found[4]["score"] == pytest.approx(0.25 * plain)


def test_a_candidate_without_vector_needs_the_floor(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(recall.final_score(none, F.lit(1.0), {"decay": F.lit(0.3)}, none).alias("a"), recall.final_score(none, F.lit(1.0), {"time": F.lit(1.0)}, F.lit(0.25)).alias("b")).first()
    assert row["a"] == 0.0 and row["b"] == 0.75


def test_decisions(spark):
    ddl = "id long, seq long, source string, text string, distance double, own_words boolean"
    rows = spark.createDataFrame(
        [(1, 1, "mail", "a", 0.9, False), (2, 2, "mail", " A ", 0.9, False), (3, 3, "mail", "near", 0.1, False), (4, 4, "mail", "mine", 0.1, True), (5, 5, "mail", "old", None, None), (6, 6, "mail", None, None, None)], ddl
    )
    ledger = rows.where("id = 5").select(F.concat(F.lit("c:"), F.sha2(F.lit("old"), 256)).alias("hash"))
    made = {r["id"]: r["decision"] for r in salience.decide(rows, ledger, 100).collect()}
    assert made == {1: "PROMOTE", 2: "CORROBORATE", 3: "CORROBORATE", 4: "PROMOTE", 5: "CORROBORATE", 6: "PROMOTE"}
    assert {r["id"]: r["decision"] for r in salience.decide(rows, ledger, 10).collect()}[3] == "PROMOTE"


def test_briefs_equal_a_plain_loop(spark):
    """The whole plan's briefs from its ranked candidates, by a loop over each question."""
    import numpy as np

    from memloom import config as C
    from memloom.plans import recall as plans

    sf = "/root/testdata/sf0.001"
    best, got = {}, {}
    for r in plans._ranked(spark, sf).collect():
        best.setdefault(r["query"], []).append(r)
    for r in plans.recall_briefs(spark, sf).collect():
        got.setdefault(r["query"], []).append((r["position"], r["id"], r["content"]))
    assert best and set(got) == set(best)
    for q, rows in best.items():
        rows.sort(key=lambda r: r["place"])
        v = np.array([r["embedding"] or [0.0] * 64 for r in rows], float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        chosen, left, spent, want = [], list(range(len(rows))), 0, []
        while left and len(chosen) < C.MMR_OUTPUT:
            gain = [C.MMR_LAMBDA * rows[i]["score"] - (1 - C.MMR_LAMBDA) * max([0.0, *(float(v[i] @ v[j]) for j in chosen)]) for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        for k, i in enumerate(chosen[: C.BRIEF_ITEMS]):
            content = rows[i]["text"][: C.BRIEF_ITEM_CHARS][: max(0, C.BRIEF_CHARS - spent)]
            if spent < C.BRIEF_CHARS:
                want.append((k, rows[i]["id"], content))
            spent += min(C.BRIEF_ITEM_CHARS, len(rows[i]["text"]))
        assert sorted(got[q]) == want


def test_jitter_is_that_of_the_seed(spark):
    import hashlib

    from memloom.operators import selection

    rows = [("seed-1", k) for k in range(20)] + [("s", 300)]
    made = spark.createDataFrame(rows, "seed string, place long").select("seed", "place", selection.jitter(F.col("seed"), F.col("place"))).collect()
    for seed, place, value in made:
        digest = hashlib.sha256(seed.encode() + (place // 8).to_bytes(8, "little")).digest()
        whole = int.from_bytes(digest[4 * (place % 8) :][:4], "little")
        assert value == pytest.approx(2 * whole / 0xFFFFFFFF - 1, abs=1e-12)


def test_a_rerank_slot_replaces_scores(spark):
    rows = [(1, i, "s", f"text {i}", None, 1.0 - i / 10) for i in range(4)]
    scored = spark.createDataFrame(rows, "query long, id long, seed string, text string, embedding array<double>, score double")
    none = spark.createDataFrame([(1, 0), (1, 0)], "query long, id long")
    plain = recall.ranked(scored, none, inputs=3).orderBy("place").collect()
    assert [r["id"] for r in plain] == [1, 2, 3] and plain[0]["flag"] == "normal" and sum(r["propensity"] for r in plain) == pytest.approx(1)
    turned = recall.ranked(scored, none, inputs=3, rerank=lambda c: c.select("query", "id", (-F.col("score")).alias("score"))).orderBy("place").collect()
    assert [r["id"] for r in turned] == [3, 2, 1]


def test_no_text_goes_along_with_candidates(spark, monkeypatch):
    """Work tables of recall have numbers and hashes only; texts come in, cut to a brief's items, for the best."""
    from memloom import config as C
    from memloom.plans import recall as plans

    seen, write = {}, plans.written

    def written(df, label):
        seen[label] = df.columns
        return write(df, label)

    monkeypatch.setattr(plans, "written", written)
    assert plans.recall_briefs(spark, "/root/testdata/sf0.001").count() > 0
    assert "scored" in seen and not {"text", "embedding"} & {c for columns in seen.values() for c in columns if columns is not seen.get("questions")}
    assert max(len(r["text"] or "") for r in plans._ranked(spark, "/root/testdata/sf0.001", C.BRIEF_ITEM_CHARS).select("text").collect()) <= C.BRIEF_ITEM_CHARS
