"""Operators on small hand-made frames."""

from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import events, graph, messaging, retrieval


def test_rrf_ranks_start_at_zero(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    b = spark.createDataFrame([(2, 7.0)], "id long, score double")
    found = {r["id"]: r["rrf"] for r in retrieval.rrf([a, b]).collect()}
    assert abs(found[1] - 1 / 60) < 1e-12 and abs(found[2] - (1 / 61 + 1 / 60)) < 1e-12


def test_cascade_needs_all_parents(spark):
    edges = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (12, 11)], "child long, parent long")
    gone = graph.cascade(edges, spark.createDataFrame([(1,)], "id long"), 3)
    assert {r["id"] for r in gone.collect()} == {1, 11, 12}


def test_excise_takes_the_least_depth(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 3), (5, 4)], "child long, parent long")
    found = {r["id"]: (r["depth"], r["weight"]) for r in graph.excise(edges, spark.createDataFrame([(1,)], "id long")).collect()}
    assert found == {2: (1, 1.0), 3: (1, 1.0), 4: (2, 0.5), 5: (3, 0.25)}


def test_trailing_run(spark):
    turns = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 1, True)], "thread string, seq long, from_me boolean")
    assert {r["thread"]: r["waiting"] for r in messaging.trailing_run(turns).collect()} == {"a": 2, "b": 0}


def test_within_is_inclusive_and_keyed(spark):
    a = spark.createDataFrame([("k", 10), ("k", 31), ("z", 10)], "key string, at long")
    b = spark.createDataFrame([("k", 20)], "key string, at long")
    assert [(r["key"], r["at"]) for r in events.within(a, b, "key", 10).collect()] == [("k", 10)]


def test_redaction_and_hash(spark):
    row = spark.createDataFrame([("mail me@x.org  now",)], "t string").select(text.redact(F.col("t")).alias("r"), text.normalised(F.col("t")).alias("n")).first()
    assert row["r"] == "mail me@x.org  now" and row["n"] == "mail me@x.org now"


def test_secrets_need_a_left_boundary(spark):
    key, pat = "AKIA" + "ABCDEFGH12345678", "gh" + "p_" + "a1" * 18
    cases = {
        f"k={key}": "k=[REDACTED:aws_access_key_id]", f"x{key}": f"x{key}", f"_{key}": f"_{key}", f"{key} {key}": "[REDACTED:aws_access_key_id] [REDACTED:aws_access_key_id]",
        f"({pat})": "([REDACTED:github_pat])", pat[:30]: pat[:30], "xapp-1-A123-456789": "[REDACTED:slack_token]", "sk-" + "proj-" + "a" * 20: "[REDACTED:openai_sk_proj]",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.redact(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == cases


def test_damping_adds_the_signals_of_the_window(spark):
    rows = [("a", "direct", 1), ("a", "paraphrase", 2), ("a", "correction", 3), ("a", "dismiss", 4), ("a", "inherited", 5), ("a", "surfacing", 6), ("a", "direct", 15), ("a", "no_engagement", 1),
            ("b", "expunged", 90), ("b", "direct", 1), ("c", "unknown", 1), *[("d", "correction", 1)] * 20]
    frame = spark.createDataFrame(rows, "subject string, signal string, days int").selectExpr("subject", "signal", "timestamp'2024-02-01 00:00:00' - make_dt_interval(days) AS ts")
    found = {r["subject"]: round(r["coefficient"], 6) for r in events.damping(frame, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()}
    assert found == {"a": round(1 + 0.05 + 0.035 + 0.06 - 0.025 + 0.025 - 0.02, 6), "b": 0.5, "c": 1.0, "d": 1.5}
