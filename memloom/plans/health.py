"""Queries of health, of graded evaluation, of policies and of the catch-up order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import extract
from memloom.operators import evaluation, messaging, monitoring, policies
from memloom.plans.registry import NOW, query, rounded, table


def _now():
    return F.lit(NOW).cast("timestamp")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(CASE WHEN user_id % 11 = 0 THEN 1 END) AS blank, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY 1, 2""")
def health_days(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("source"), "ts", (F.col("user_id") % 11 == 0).alias("blank"), "value")
    return monitoring.day_partials(rows).withColumns({"total": rounded("total", 4), "day": F.col("day").cast("string")})


@query("""SELECT event_type AS source, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n, count(CASE WHEN user_id % 11 = 0 THEN 1 END) AS blank, round(sum(value), 4) AS total, max(value) AS high
FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-01' AND CAST(ts AS DATE) <= DATE '2024-01-31' GROUP BY 1""")
def health_report(spark, sf_dir):
    """Two folds of day rows, as from two runs, merged."""
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("source"), "ts", (F.col("user_id") % 11 == 0).alias("blank"), "value")
    early, late = (monitoring.day_partials(rows.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return monitoring.merge_days(early.unionByName(late), _now().cast("date")).withColumn("total", rounded("total", 4))


@query("""SELECT source, count(*) AS n, round(avg(CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.0 END), 6) AS drop_rate, count(*) >= 100 AND min(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) = 1 AS alert FROM documents GROUP BY 1""")
def funnel_drop_rate(spark, sf_dir):
    decision = F.when(F.col("n_chars") < 500, "DROP").otherwise("PASS")
    rows = table(spark, sf_dir, "documents").select("source", decision.alias("decision"))
    return monitoring.funnel_alert(rows).withColumn("drop_rate", rounded("drop_rate"))


@query("""WITH a AS (SELECT event_type AS source, count(*) AS n, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS age FROM events GROUP BY 1)
SELECT source, n, age AS age_seconds, age > 3600 * (CASE source WHEN 'view' THEN 48 WHEN 'click' THEN 12 ELSE 6 END) AS stale FROM a""")
def capture_staleness(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("source"), "ts")
    return monitoring.capture_staleness(rows, _now(), {"view": 48, "click": 12})


@query("""WITH t AS (SELECT event_type AS source, max(ts) AS tail, max(CASE WHEN user_id % 97 = 0 AND event_type <> 'error' THEN ts END) AS cur, max(CASE WHEN event_type <> 'view' THEN TIMESTAMP '2024-01-30 23:30:00' ELSE TIMESTAMP '2024-01-30 20:00:00' END) AS modified FROM events GROUP BY 1),
l AS (SELECT source, epoch_ms(tail) - epoch_ms(cur) AS lag_ms, epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(modified) < 3600000 AS growing FROM t)
SELECT source, round(lag_ms / 3600000.0, 6) AS lag_hours, growing, coalesce(lag_ms > 86400000 AND growing, false) AS warned FROM l""")
def cursor_lag(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("source", F.col("event_type"))
    modified = F.when(F.col("source") != "view", "2024-01-30 23:30:00").otherwise("2024-01-30 20:00:00").cast("timestamp")
    tails = e.groupBy("source").agg(F.max("ts").alias("tail_ts"), F.max(modified).alias("modified"))
    cursors = e.where("user_id % 97 = 0 and event_type <> 'error'").groupBy("source").agg(F.max("ts").alias("cursor_ts"))
    made = monitoring.cursor_lag(tails, cursors, _now())
    return made.select("source", rounded(F.col("lag_ms") / 3600000).alias("lag_hours"), "growing", "warned")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS model, event_type AS source, count(*) AS calls, CAST(sum(user_id % 1000) AS BIGINT) AS tokens,
  round(CAST(sum((user_id % 1000) * (CASE WHEN event_id % 2 = 0 THEN 0.13 ELSE 0.02 END)) / 1000000 AS DOUBLE), 9) AS cost FROM events GROUP BY 1, 2, 3""")
def embed_cost(spark, sf_dir):
    large = F.col("event_id") % 2 == 0
    rows = _events(spark, sf_dir).select(
        "ts", F.when(large, "large").otherwise("small").alias("model"), F.col("event_type").alias("source"), (F.col("user_id") % 1000).cast("long").alias("tokens"), F.when(large, 0.13).otherwise(0.02).alias("price")
    )
    return monitoring.embed_cost(rows).withColumns({"cost": rounded("cost", 9), "day": F.col("day").cast("string")})


@query("""SELECT count(*) AS total, count(CASE WHEN user_id % 19 = 0 THEN 1 END) AS matches, round(count(CASE WHEN user_id % 19 = 0 THEN 1 END) / count(*), 6) AS fraction,
  count(CASE WHEN user_id % 19 = 0 THEN 1 END) / count(*) > 0.05 AS warned FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'""")
def hostname_dominance(spark, sf_dir):
    week = _events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-24").cast("timestamp")) & (F.col("ts") < _now()))
    return monitoring.hostname_dominance(week.select((F.col("user_id") % 19 == 0).alias("matched"))).withColumn("fraction", rounded("fraction"))


@query("""WITH h AS (SELECT DISTINCT doc_id FROM labels) SELECT count(*) AS eligible, count(h.doc_id) AS indexed, round(count(h.doc_id) / count(*), 6) AS ratio, count(h.doc_id) / count(*) >= 0.98 AS ok
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN h USING (doc_id)""")
def index_coverage(spark, sf_dir):
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("id"))
    return monitoring.index_coverage(ids("documents"), ids("labels"), 0.98).withColumn("ratio", rounded("ratio"))


@query("""SELECT count(*) AS sample, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END), 6) AS rate,
  CASE WHEN count(*) < 100 THEN 'inconclusive' WHEN avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'green' ELSE 'red' END AS verdict FROM events""")
def recall_liveness(spark, sf_dir):
    return monitoring.liveness(_events(spark, sf_dir).select((F.col("value") > 40).alias("found"))).withColumn("rate", rounded("rate"))


@query("""WITH r AS (SELECT user_id AS event, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
g AS (SELECT *, event_type = 'purchase' AS e, event_type = 'error' AS f, event_type = 'click' AND id % 3 = 0 AS n FROM r),
s AS (SELECT event, count(CASE WHEN e THEN 1 END) AS e, count(CASE WHEN n THEN 1 END) AS n, coalesce(sum(CASE WHEN rank <= 12 THEN (CASE WHEN f THEN -2.0 WHEN e THEN 2.0 WHEN n THEN 1.0 ELSE 0.0 END) / log2(rank + 1) END), 0.0) AS dcg,
  count(CASE WHEN rank <= 12 AND f THEN 1 END) > 0 AS harm FROM g GROUP BY 1)
SELECT event, round(CASE WHEN e + n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(12, e + n) AS BIGINT) + 1), lambda i: (CASE WHEN i <= e THEN 2.0 ELSE 1.0 END) / log2(i + 1))) END, 6) AS ndcg, harm FROM s""")
def graded_metrics(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = e.select(F.col("user_id").alias("event"), F.col("event_id").alias("id"), F.row_number().over(w).alias("rank"))
    kind = F.col("event_type")
    role = F.when(kind == "purchase", "expected").when(kind == "error", "forbidden").when((kind == "click") & (F.col("event_id") % 3 == 0), "neighbour")
    labels = e.select(F.col("user_id").alias("event"), F.col("event_id").alias("id"), role.alias("role")).where("role is not null")
    return evaluation.graded(ranked, labels).withColumn("ndcg", rounded("ndcg"))


@query("""WITH r AS (SELECT source AS leg, CASE WHEN doc_id % 31 < 26 THEN doc_id % 31 END AS rank FROM documents)
SELECT leg, count(*) AS n, round(1 - count(CASE WHEN rank < 20 THEN 1 END) / count(*), 6) AS failure_20, round(count(CASE WHEN rank < 5 THEN 1 END) / count(*), 6) AS recall_5,
  round(count(CASE WHEN rank < 10 THEN 1 END) / count(*), 6) AS recall_10, round(count(CASE WHEN rank < 20 THEN 1 END) / count(*), 6) AS recall_20 FROM r GROUP BY 1""")
def failure_rates(spark, sf_dir):
    rank = F.col("doc_id") % 31
    made = evaluation.failure_rates(table(spark, sf_dir, "documents").select(F.col("source").alias("leg"), F.when(rank < 26, rank).alias("rank")))
    return made.select("leg", "n", *[rounded(c).alias(c) for c in ("failure_20", "recall_5", "recall_10", "recall_20")])


@query("""WITH p AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(event_id, event_id) AS captured_at FROM events GROUP BY 1),
a AS (SELECT user_id AS predicate_id, captured_at FROM p WHERE kind <> 'error')
SELECT predicate_id, captured_at, (SELECT count(*) FROM a) AS total_active, (SELECT count(*) FROM a) > 1024 AS truncated FROM a ORDER BY captured_at, predicate_id LIMIT 1024""")
def predicate_list(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "rescind").otherwise("exclude")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("predicate_id"), F.col("event_id").alias("captured_at"), action.alias("action"), F.col("event_id").alias("seq"))
    return policies.list_predicates(policies.active_predicates(rows))


@query("""SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey % 13 = 0 OR l_partkey % 17 = 0""")
def revoked_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    refs = rows.select(F.col("l_orderkey").alias("id"), F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")).alias("source_refs"))
    gone = rows.select(F.concat(F.lit("s"), "l_suppkey").alias("source_ref")).where(F.col("l_suppkey") % 13 == 0)
    return policies.revoked_ids(refs, gone.union(rows.where("l_partkey % 17 = 0").select(F.concat(F.lit("p"), "l_partkey"))).distinct())


@query("""WITH b AS (SELECT user_id, arg_max(CASE WHEN event_type <> 'view' THEN value END, event_id) FILTER (WHERE event_type <> 'view') AS v, max(event_id) AS last, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN kind <> 'view' THEN coalesce(v, c_acctbal) ELSE c_acctbal END AS valence, coalesce(kind, 'none') AS label FROM customer LEFT JOIN b ON user_id = c_custkey""")
def backfill_overlay(spark, sf_dir):
    """The latest row alone counts: where it lacks a channel, the candidate's own stays."""
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("target"), F.lit(1).alias("version"), e.alias("ts"), e.alias("id"), F.when(F.col("event_type") != "view", F.col("value")).alias("valence"), F.col("event_type").alias("label")
    )
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("valence"), F.lit("none").alias("label"))
    return policies.overlay(facts, rows, ["valence", "label"])


@query("""WITH p AS (SELECT l_orderkey AS id, bool_and(l_partkey % 3 = 0) AS gone FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN gone AND id % 2 = 0 THEN 0.0 ELSE 1.0 END AS gate FROM p""")
def derivation_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_orderkey") % 2 == 0, "reconstructed").otherwise("fact")
    made = rows.groupBy(F.col("l_orderkey").alias("id"), kind.alias("kind")).agg(F.collect_set("l_partkey").alias("parents"))
    return policies.derivation_gate(made, rows.where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("id")).distinct())


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, count(*) AS n, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS bought FROM events GROUP BY 1),
s AS (SELECT user_id AS thread, CASE WHEN bought > 2 THEN 'relationship' ELSE 'unknown' END AS tier, user_id % 3 = 0 AS contact, ts,
  round((0.05 + 0.95 * least(1.0, greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 604800000000.0))) * (0.3 + (user_id % 7) / 10.0) * 0.7 * (CASE WHEN n > 10 THEN n / 10.0 ELSE 1.0 END), 6) AS score FROM l)
SELECT thread, tier, contact, score FROM s ORDER BY CASE tier WHEN 'relationship' THEN 0 ELSE 1 END, CASE WHEN contact THEN 0 ELSE 1 END, s.score DESC, ts DESC, thread LIMIT 50""")
def catchup_order(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("thread")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    score = messaging.catchup_score(F.col("ts"), _now(), 0.3 + (F.col("thread") % 7) / 10, F.lit(0.7), F.col("n") / 10)
    made = rows.select("thread", F.when(F.col("bought") > 2, "relationship").otherwise("unknown").alias("tier"), (F.col("thread") % 3 == 0).alias("contact"), rounded(score).alias("score"), "ts")
    return messaging.catchup_order(made).drop("ts")


@query("""SELECT conv_id AS thread, arg_max(role, turn) AS role, max(turn) AS seq FROM conversations GROUP BY 1""")
def last_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), "role", F.col("turn").alias("seq"))
    return messaging.last_rows(rows)


@query("""WITH k AS (SELECT conv_id AS id, turn, CASE WHEN turn % 2 = 0 THEN 'person:' || role ELSE 'topic:' || substring(md5(role), 1, 8) || '_0000_4000_8000_' || substring(md5(role), 1, 12) || (CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'x' END) END AS key FROM conversations)
SELECT id, turn, key, key IN ('person:user', 'person:assistant') OR (key LIKE 'topic:%' AND length(key) = 42) AS noise FROM k""")
def noise_entities(spark, sf_dir):
    h = F.md5("role")
    topic = F.concat(F.lit("topic:"), F.substring(h, 1, 8), F.lit("_0000_4000_8000_"), F.substring(h, 1, 12), F.when(F.col("conv_id") % 2 == 0, "").otherwise("x"))
    key = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("person:"), "role")).otherwise(topic)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", key.alias("key"))
    return rows.withColumn("noise", extract.noise_entity(F.col("key")))
