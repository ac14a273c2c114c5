"""Queries of evaluation, observability, persona and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import evaluation, events, graph, messaging
from memloom.plans.queries import _EDGES_SQL, _edges, _STOP, _turns
from memloom.plans.registry import NOW, facts, query, rounded, table

_RANKED = "r AS (SELECT l_orderkey AS event, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank, l_quantity >= 25 AS relevant FROM lineitem)"


def _ranked(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.row_number().over(w).alias("rank"), (F.col("l_quantity") >= 25).alias("relevant"))


@query(f"""WITH {_RANKED},
s AS (SELECT event, sum(CASE WHEN relevant AND rank <= 3 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS n, min(CASE WHEN relevant AND rank <= 3 THEN rank END) AS first,
  sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg FROM r GROUP BY 1)
SELECT event, round(found / n, 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, least(3, CAST(n AS INTEGER)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM s WHERE n > 0""")
def eval_metrics(spark, sf_dir):
    found = evaluation.metrics(_ranked(spark, sf_dir), 3).where("recall is not null")
    return found.select("event", *[rounded(c).alias(c) for c in ("recall", "rr", "ndcg")])


@query("""WITH n AS (SELECT sum((value < 200 AND event_type <> 'view')::INT) AS tp, sum((value >= 200 AND event_type <> 'view')::INT) AS fp, sum((value < 200 AND event_type = 'view')::INT) AS fn FROM events)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n""")
def abstain_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") < 200).alias("should"), (F.col("event_type") != "view").alias("did"))
    return evaluation.abstain_f1(rows).withColumn("f1", rounded("f1"))


@query("""WITH g AS (SELECT e, d FROM (VALUES (0.0::DOUBLE), (0.01), (0.02), (0.04)) a(e), (VALUES (0.0::DOUBLE), (0.01), (0.02), (0.03)) b(d)),
r AS (SELECT l_orderkey AS event, e, d, l_quantity >= 25 AS relevant, row_number() OVER (PARTITION BY l_orderkey, e, d
  ORDER BY CAST(round((l_discount + e * (l_partkey % 7) + d * (l_suppkey % 5)) * 1e6) AS BIGINT) DESC, l_linenumber * 1000000 + l_partkey, l_quantity >= 25) AS rank FROM lineitem, g),
s AS (SELECT event, e, d, sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS n, sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg FROM r GROUP BY 1, 2, 3)
SELECT e AS engagement, d AS damping, round(avg(dcg / list_sum(list_transform(range(1, least(3, CAST(n AS INTEGER)) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM s WHERE n > 0 GROUP BY 1, 2""")
def grid_calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_discount").alias("base"),
        (F.col("l_partkey") % 7).alias("eng"), (F.col("l_suppkey") % 5).alias("damp"), (F.col("l_quantity") >= 25).alias("relevant"),
    )
    return evaluation.grid(rows, 3).withColumn("ndcg", rounded("ndcg"))


@query()
def bootstrap_ci(spark, sf_dir):
    """Of the mean quality label."""
    return evaluation.bootstrap_ci(table(spark, sf_dir, "labels").select(F.col("quality").alias("value")))


_DAYS = """days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS entities,
  avg(CASE WHEN event_type <> 'error' AND ts < TIMESTAMP '2024-01-24 00:00:00' THEN 1.0 ELSE 0.0 END) AS anchors FROM events GROUP BY 1)"""


def _days(spark, sf_dir):
    entity = F.when(F.col("value") > 20, "e")
    anchor = F.when((F.col("event_type") != "error") & (F.col("ts") < F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")), "a")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), entity.alias("entities"), anchor.alias("anchors"))
    return events.coverage(rows, ["entities", "anchors"])


@query(f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, round(entities, 6) AS entities, round(anchors, 6) AS anchors FROM days")
def coverage_by_window(spark, sf_dir):
    return _days(spark, sf_dir).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", rounded("entities").alias("entities"), rounded("anchors").alias("anchors"))


@query(f"""WITH {_DAYS}, a AS (SELECT date_diff('day', day, DATE '2024-01-31') AS age, * FROM days),
f AS (SELECT 'entities' AS field, age, n, entities AS x FROM a UNION ALL SELECT 'anchors', age, n, anchors FROM a),
s AS (SELECT field, sum(CASE WHEN age >= 7 AND age < 30 THEN x * n END) / sum(CASE WHEN age >= 7 AND age < 30 THEN n END) AS b, sum(CASE WHEN age >= 0 AND age < 7 THEN x * n END) / sum(CASE WHEN age >= 0 AND age < 7 THEN n END) AS c FROM f GROUP BY 1)
SELECT field, round(b, 6) AS before, round(c, 6) AS after, CASE WHEN round(b - c, 9) >= 0.1 THEN 'critical' WHEN round(b - c, 9) > 0.05 THEN 'warn' ELSE 'ok' END AS level FROM s""")
def drift_alerts(spark, sf_dir):
    found = events.drift(_days(spark, sf_dir), ["entities", "anchors"], F.lit(NOW).cast("date"))
    return found.select("field", rounded("before").alias("before"), rounded("after").alias("after"), "level")


@query("""SELECT CASE WHEN vec_id IS NOT NULL THEN 'embedded' WHEN source = 'src1' THEN 'opted_out' WHEN coalesce(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '') = '' THEN 'blank' ELSE 'pending' END AS state, count(*) AS n
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def embed_census(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return events.embed_census(facts(spark, sf_dir), vectors, F.coalesce(F.col("source") == "src1", F.lit(False)))


@query("""WITH f AS (SELECT event_type AS repo, user_id AS author, CAST(isoyear(ts) AS INTEGER) AS year, CAST(weekofyear(ts) AS INTEGER) AS week, event_type || ':' || event_id AS content,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type, user_id, isoyear(ts), weekofyear(ts)) AS n FROM events WINDOW w AS (PARTITION BY event_type, user_id, isoyear(ts), weekofyear(ts) ORDER BY ts, event_id))
SELECT repo, author, year, week, max(n) AS n_facts, substring(string_agg(content, chr(10) ORDER BY rn), 1, 500) AS content FROM f WHERE n >= 2 AND rn <= 16 GROUP BY 1, 2, 3, 4""")
def project_week_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("repo"), F.col("user_id").alias("author"), "ts", F.col("event_id").alias("id"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("content")
    )
    return events.project_weeks(rows)


@query(f"""WITH m AS (SELECT conv_id % 20 AS person, conv_id AS thread, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '' AND t NOT IN ({_STOP})) AS w FROM conversations),
per AS (SELECT person, thread, unnest(w) AS term FROM m UNION ALL SELECT person, thread, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM m)),
c AS (SELECT person, term, count(*) AS tf, count(DISTINCT thread) AS df FROM per GROUP BY 1, 2),
t AS (SELECT conv_id % 20 AS person, count(DISTINCT conv_id) AS threads FROM conversations GROUP BY 1),
k AS (SELECT person, term, tf, row_number() OVER (PARTITION BY person ORDER BY tf DESC, term) AS rank FROM c JOIN t USING (person) WHERE threads = 1 OR df < 0.8 * threads)
SELECT person, term, tf, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12""")
def topic_terms(spark, sf_dir):
    rows = _turns(spark, sf_dir).select((F.col("thread") % 20).alias("person"), "thread", "text")
    return messaging.topics(rows)


@query("""WITH g AS (SELECT user_id AS thread, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT thread, count(gap) AS n, sum(gap) AS total, max_by(gap, (ts, event_id)) AS last FROM g WHERE gap IS NOT NULL GROUP BY 1),
r AS (SELECT thread, n, CASE WHEN total > last THEN last * (n - 1) / (total - last) END AS ratio FROM s)
SELECT thread, n, round(ratio, 6) AS ratio, CASE WHEN ratio <= 0.8 THEN 'accelerating' WHEN ratio >= 1.2 THEN 'cooling' ELSE 'steady' END AS trend FROM r""")
def gap_trend(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return messaging.gap_trend(rows).withColumn("ratio", rounded("ratio"))


@query("""WITH s AS (SELECT event_id AS id, user_id % 2 = 0 AS dm, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.5 END AS wa, 0.3 AS wr, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 0.2 END AS wm,
  value > 50 AS addressed, value > 100 AS reply, value < 75 AS mention, (CASE WHEN user_id % 3 = 0 THEN 0.4 ELSE 1.0 END) * (CASE WHEN user_id % 4 = 0 THEN 0.7 ELSE 1.0 END) AS trust FROM events),
e AS (SELECT id, dm, least(1.0, (wa * addressed::INT + wr * reply::INT + wm * mention::INT * trust) * (1 + 0.6 * (1 - wa - wr - wm) / (wa + wr + wm))) AS ev FROM s)
SELECT id, round(CAST(CASE WHEN dm THEN 0.5 + ev * 0.5 ELSE ev END AS DOUBLE), 6) AS score FROM e""")
def directedness_score(spark, sf_dir):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    made = messaging.directedness(
        u % 2 == 0, {"addressed": v > 50, "reply": v > 100, "mention": v < 75}, {"addressed": e % 3 != 0, "reply": F.lit(True), "mention": e % 5 != 0}, u % 3 != 0, u % 4 != 0
    )
    return table(spark, sf_dir, "events").select(e.alias("id"), rounded(made).alias("score"))


@query("""WITH w AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0 WHEN contains(text, '?') THEN 1.0 WHEN n >= 8 THEN 1.0 WHEN n <= 4 THEN 0.0 ELSE 0.5 + 0.5 * (n - 4) / 4 END AS score FROM w""")
def substance_score(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messaging.substance(F.col("text")).alias("score"))


_LINKS = "links AS (SELECT o_orderkey AS a, 10000000000 + o_custkey AS b FROM orders)"


@query(f"""WITH RECURSIVE {_LINKS}, e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT u AS id, u AS other FROM e UNION SELECT r.id, e.v FROM reach r JOIN e ON e.u = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def connected_components(spark, sf_dir):
    """Orders and customers as nodes: the least order of each customer."""
    rows = table(spark, sf_dir, "orders")
    return graph.components(rows.select(F.col("o_orderkey").alias("a"), (10000000000 + F.col("o_custkey")).alias("b")))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, seeds AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey <= 20),
walk AS (SELECT id, 0 AS d FROM seeds UNION SELECT e.child, w.d + 1 FROM walk w JOIN edges e ON e.parent = w.id WHERE w.d < 16),
m AS (SELECT id, min(d) AS distance FROM walk GROUP BY id)
SELECT id, distance, id % 7 = 0 AS rescued, round(CASE WHEN id % 7 = 0 THEN 1.0 WHEN distance = 0 THEN 0.05 ELSE greatest(0.05, 0.5 * exp(-0.4 * (distance - 1))) END, 6) AS factor FROM m""")
def orphan_decay(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "lineitem").where("l_partkey <= 20").select(F.col("l_partkey").alias("id"))
    nodes = edges.select(F.col("parent").alias("id")).union(edges.select("child")).where("id % 7 = 0")
    return graph.orphans(edges, seeds, nodes).withColumn("factor", rounded("factor"))
