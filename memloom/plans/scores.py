"""Queries of text functions and of selection among candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions import affect, extract
from memloom.functions.text import tokens
from memloom.operators import events, selection
from memloom.plans.queries import _STOP, _TOKENS, TERMS, _vectors
from memloom.plans.registry import facts, query, rounded, table


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_FELT = "text || CASE doc_id % 4 WHEN 0 THEN ' Happy, great day' WHEN 1 THEN ' sad and BROKEN pain' ELSE '' END"
_HITS = "len(list_filter(w, lambda t: t IN ({})))"


@query(f"""WITH r AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower({_FELT}), '[^a-z]+'), lambda t: t <> '' AND t NOT IN ({_listed(C.NEUTRAL_WORDS)})) AS w FROM documents),
s AS (SELECT id, len(w) AS n, ({_HITS.format(_listed(C.POSITIVE_WORDS))} - {_HITS.format(_listed(C.NEGATIVE_WORDS))}) / sqrt(len(w)) AS v FROM r)
SELECT id, round(CASE WHEN n < 2 OR abs(v) < 0.05 THEN 0.0 ELSE greatest(-1.0, least(1.0, v)) END, 6) AS valence FROM s""")
def valence_score(spark, sf_dir):
    more = F.when(F.col("id") % 4 == 0, " Happy, great day").when(F.col("id") % 4 == 1, " sad and BROKEN pain").otherwise("")
    return facts(spark, sf_dir).select("id", rounded(affect.valence(F.concat("text", more))).alias("valence"))


@query("""SELECT event_id AS id, round(1 / (1 + exp(-(-1.5 + 1.2 * (CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) + 0.4 * ln(1 + user_id % 5) - 0.7 * (value % 10) / 10 + 0.3 * (event_id % 3) / 3.0))), 6) AS score FROM events""")
def episodicity_score(spark, sf_dir):
    anchored = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    made = affect.episodicity(anchored, F.col("user_id") % 5, (F.col("value") % 10) / 10, (F.col("event_id") % 3) / 3.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), rounded(made).alias("score"))


_SLUG = "substring(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64)"
_FOUND = ", ".join(f"list_transform(regexp_extract_all(t, '{shape}'), lambda x: '{kind}:' || source || ':' || {_SLUG})" for kind, shape in extract.ENTITY_SHAPES)


@query(f"""WITH r AS (SELECT doc_id, source, text || CASE WHEN doc_id % 3 = 0 THEN ' write to Team.' || source || '@example.org or see https://example.org/a/' || doc_id || ' #Plan-B +44 20 7946 0' || (100 + doc_id % 900) ELSE '' END AS t FROM documents)
SELECT doc_id AS id, array_to_string((list_sort(list_distinct(flatten([{_FOUND}]))))[1:32], ',') AS entities FROM r""")
def entity_extract(spark, sf_dir):
    more = F.when(
        F.col("id") % 3 == 0,
        F.concat(F.lit(" write to Team."), "source", F.lit("@example.org or see https://example.org/a/"), F.col("id").cast("string"), F.lit(" #Plan-B +44 20 7946 0"), (100 + F.col("id") % 900).cast("string")),
    ).otherwise("")
    rows = facts(spark, sf_dir).withColumn("t", F.concat("text", more))
    return rows.select("id", F.array_join(extract.entities(F.col("t"), F.col("source")), ",").alias("entities"))


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%d') || ',' || strftime(CAST(ts AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') || ',' || strftime(CAST(ts AS DATE) + CAST(7 * (1 + user_id % 9) AS INTEGER), '%Y-%m-%d') || ',2024-02-29' AS days FROM events""")
def time_anchor_extract(spark, sf_dir):
    day = F.col("ts").cast("date")
    said = F.concat(F.lit("Met on "), F.date_format("ts", "yyyy-MM-dd"), F.lit("; not Yesterday but in "), (1 + F.col("user_id") % 9).cast("string"), F.lit(" weeks, or February 29, 2024, never 2023-02-30."))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), extract.time_anchors(said, day).alias("a"))
    return rows.select("id", F.array_join(F.transform("a", lambda x: F.date_format(x["day"], "yyyy-MM-dd")), ",").alias("days"))


@query("""WITH r AS (SELECT doc_id AS id, text, greatest(1, CAST(ceil((length(text) - 50) / 350.0) AS INTEGER)) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT id, text, unnest(range(0, n)) AS k FROM r)
SELECT id, CAST(k AS INTEGER) AS k, sha256(substring(text, CAST(k * 350 + 1 AS INTEGER), 400)) AS chunk FROM k""")
def chunk_text(spark, sf_dir):
    rows = facts(spark, sf_dir).where("text is not null").select("id", F.inline(extract.chunks(F.col("text"), 400, 50)))
    return rows.select("id", "k", F.sha2("chunk", 256).alias("chunk"))


@query("""SELECT event_id AS id, 'Conversation: ' || user_id || ' Source: ' || event_type || ' Entities: person_' || user_id || ', kind_' || event_type || ' Date: ' || strftime(ts, '%Y-%m-%d') AS prefix FROM events""")
def context_prefix(spark, sf_dir):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    names = F.array(F.concat(F.lit("person_"), user), F.concat(F.lit("kind_"), kind))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), extract.context_prefix(user, kind, names, F.date_format("ts", "yyyy-MM-dd")).alias("prefix"))


@query("""SELECT round(avg(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS avg, (SELECT count(*) FROM embeddings) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def avg_pairwise_cosine(spark, sf_dir):
    return selection.avg_pairwise_cosine(_vectors(spark, sf_dir)).select("n", rounded("avg").alias("avg"))


@query("""WITH b AS (SELECT event_type, max(value) AS m, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, max(n) AS n, count(*) AS near, CASE WHEN count(*) >= 60 THEN 'crowded' WHEN max(n) < 3 THEN 'sparse' ELSE 'normal' END AS flag FROM events JOIN b USING (event_type) WHERE value >= 0.95 * m GROUP BY 1""")
def density_flag(spark, sf_dir):
    return selection.density(table(spark, sf_dir, "events"), "event_type", "value")


@query("""SELECT a.vec_id AS id, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) > 0.85 AS masked
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id < 8) b GROUP BY 1""")
def predicate_mask(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return selection.predicate_mask(rows, [r["embedding"] for r in rows.where("id < 8").collect()])  # the predicates are a bounded list


@query("""SELECT event_id AS id, round(value * CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.6 ELSE 1.0 END, 6) AS score FROM events""")
def consent_dampener(spark, sf_dir):
    basis = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "third_party_inferred").otherwise("first_party")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), rounded(F.col("value") * selection.consent_factor(basis)).alias("score"))


@query()
def mmr_select(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("label").cast("long").alias("query"), "id", F.col("embedding")[0].cast("double").alias("score"), "embedding")
    return selection.mmr(rows)


@query("""WITH f AS (SELECT source, doc_id AS pos, substring(text, 1, 600) AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
b AS (SELECT *, 4000 - coalesce(sum(length(content)) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f WHERE rn <= 12)
SELECT source, pos, substring(content, 1, CAST(room AS INTEGER)) AS content FROM b WHERE room > 0""")
def brief_char_budget(spark, sf_dir):
    return selection.char_budget(facts(spark, sf_dir).select("source", F.col("id").alias("pos"), F.col("text").alias("content")), "source")


@query("""WITH e AS (SELECT event_id, event_type, exp((value / 100 - max(value / 100) OVER (PARTITION BY event_type)) / 0.3) AS e FROM events)
SELECT event_id AS id, round(e / sum(e) OVER (PARTITION BY event_type), 9) AS p FROM e""")
def softmax_propensity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("value") / 100).alias("score"))
    return selection.softmax(rows, "event_type", "score").select("id", rounded("p", 9).alias("p"))


#: Entities that an order names, as match keys, and those asked for.
ENTITIES = ["person:c3", "product:p17", "product:p44", "org:s5", "org:none"]


@query(f"""WITH k AS (SELECT l_orderkey AS id, 'product:p' || l_partkey % 97 AS t FROM lineitem UNION SELECT l_orderkey, 'org:s' || l_suppkey % 23 FROM lineitem
  UNION SELECT o_orderkey, 'person:c' || o_custkey % 50 FROM orders),
r AS (SELECT DISTINCT id FROM k), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r), df AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM k GROUP BY t),
q(t) AS (VALUES {", ".join(f"('{t}')" for t in ENTITIES)}),
u AS (SELECT id, t FROM k WHERE id IN (SELECT id FROM k JOIN q USING (t)) UNION SELECT id, q.t FROM (SELECT DISTINCT id FROM k JOIN q USING (t)), q),
w AS (SELECT u.id, u.t, k.t IS NOT NULL AND u.t IN (SELECT t FROM q) AS shared,
  CASE WHEN u.id % 7 = 0 AND u.t = 'org:s5' THEN n ELSE coalesce(df, 1) END AS d, n FROM u LEFT JOIN k ON k.id = u.id AND k.t = u.t LEFT JOIN df ON df.t = u.t, n),
i AS (SELECT id, shared, ln((n - d + 0.5) / (d + 0.5) + 1) AS idf FROM w)
SELECT id, round(sum(CASE WHEN shared THEN idf ELSE 0.0 END) / sum(idf), 6) AS score FROM i GROUP BY id""")
def idf_weighted_jaccard(spark, sf_dir):
    """Between each order's entities and those asked for; every seventh order is from the channel ``org:s5``."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    named = lambda kind, c, m: F.concat(F.lit(kind), (F.col(c) % m).cast("string")).alias("key")
    keys = lines.select(F.col("l_orderkey").alias("id"), named("product:p", "l_partkey", 97)).union(lines.select("l_orderkey", named("org:s", "l_suppkey", 23)))
    keys = keys.union(orders.select("o_orderkey", named("person:c", "o_custkey", 50)))
    peers = F.when(F.col("id") % 7 == 0, F.array(F.lit("org:s5")))
    rows = keys.groupBy("id").agg(F.collect_set("key").alias("keys")).withColumn("peers", peers)  # an order has few lines
    return selection.idf_jaccard(rows, ENTITIES).select("id", rounded("score").alias("score"))


@query(f"""WITH w AS (SELECT doc_id AS id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents)
SELECT id, len(list_filter(w, lambda t: t IN ({_listed(TERMS)}) AND t NOT IN ({_STOP}))) AS n FROM w WHERE len(list_filter(w, lambda t: t IN ({_listed(TERMS)}) AND t NOT IN ({_STOP}))) > 0""")
def entity_match_count(spark, sf_dir):
    n = F.size(F.array_intersect(tokens(F.col("text")), F.array(*[F.lit(t) for t in TERMS]))).cast("long")
    return facts(spark, sf_dir).select("id", n.alias("n")).where("n > 0")


@query("""SELECT user_id AS key, max_by(event_id, (value, -event_id)) AS id, round(max(value), 6) AS score, count(*) AS duplicate_count FROM events GROUP BY 1""")
def first_wins_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), "user_id")
    return events.first_wins(rows, F.col("user_id")).withColumn("score", rounded("score"))
