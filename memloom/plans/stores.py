"""Queries of what is stored and survives runs: health by day, versioned overlays, chunks of turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import drains, health_state, retrieval
from memloom.plans.registry import NOW, facts, query, rounded, table
from memloom.session import shared_path


def _day(spark):
    return F.lit(NOW).cast("date")


_SHARES = {"entities": "user_id % 3 = 0", "anchors": "user_id % 5 = 0 AND day < DATE '2024-01-26'", "valence": "event_type <> 'error'", "episodicity": "false"}
_SHARE_SQL = " UNION ALL ".join(
    f"SELECT 'memory' AS role, '{m}' AS metric, avg(CASE WHEN NOT now THEN CASE WHEN {c} THEN 1.0 ELSE 0.0 END END) AS before, avg(CASE WHEN now THEN CASE WHEN {c} THEN 1.0 ELSE 0.0 END END) AS after FROM e" for m, c in _SHARES.items()
)


@query(f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(ts AS DATE) > DATE '2024-01-24' AS now FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-01' AND CAST(ts AS DATE) <= DATE '2024-01-31'),
s AS ({_SHARE_SQL}
  UNION ALL SELECT 'memory', 'entity_tokens', avg(CASE WHEN NOT now THEN CASE WHEN user_id % 3 = 0 THEN 2.0 ELSE 0.0 END END), avg(CASE WHEN now THEN CASE WHEN user_id % 3 = 0 THEN 2.0 ELSE 0.0 END END) FROM e
  UNION ALL SELECT 'recall', 'degraded', avg(CASE WHEN NOT now THEN CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0.0 END END), avg(CASE WHEN now THEN CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0.0 END END) FROM e WHERE event_type = 'click'
  UNION ALL SELECT 'recall', 'episodicity', 1.0, 1.0 UNION ALL SELECT 'recall', 'episodicity_sum', avg(CASE WHEN NOT now THEN value END), avg(CASE WHEN now THEN value END) FROM e WHERE event_type = 'click'
  UNION ALL SELECT 'recall', m, 0.0, 0.0 FROM (VALUES ('entities'), ('anchors'), ('valence')) v(m)),
v AS (SELECT 'v' || (CASE WHEN day >= DATE '2024-01-28' THEN 2 ELSE 1 END) AS k, bool_or(NOT now) AS old, bool_or(now) AS new FROM e GROUP BY 1)
SELECT role, metric, round(CAST(before AS DOUBLE), 6) AS before, round(CAST(after AS DOUBLE), 6) AS after, CASE WHEN metric = 'entity_tokens' THEN CASE WHEN after < 0.9 * before THEN 'warn' ELSE 'ok' END
  WHEN metric = 'episodicity_sum' THEN 'ok' WHEN round(before - after, 9) >= 0.1 THEN 'critical' WHEN round(before - after, 9) > 0.05 THEN 'warn' ELSE 'ok' END AS level FROM s
UNION ALL SELECT 'memory', 'version:entities', CAST(count(CASE WHEN old THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN new THEN 1 END) AS DOUBLE), CASE WHEN bool_or(new AND NOT old) THEN 'bump' ELSE 'ok' END FROM v""")
def health_state_report(spark, sf_dir):
    """Events as facts, clicks as recalls, folded in three batches of which one runs twice, and compacted before the last."""
    u, kind, path, today = F.col("user_id"), F.col("event_type"), shared_path(spark, "health"), _day(spark)
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(ts)
    none = F.array().cast("array<string>")
    e = table(spark, sf_dir, "events").select(
        "event_id", ts.alias("ts"), kind.alias("kind"), F.when(u % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("entities"),
        F.when((u % 5 == 0) & (day < "2024-01-26"), F.array(F.lit("x"))).alias("anchors"), F.when(kind != "error", F.col("value")).alias("valence"), F.lit(None).cast("double").alias("episodicity"),
        F.create_map(F.lit("entities"), F.when(day >= "2024-01-28", "v2").otherwise("v1")).alias("versions"), (u % 7 == 0).alias("degraded"), "value",
    )
    for batch in (0, 1, 1, 2):
        part = e.where(F.col("event_id") % 3 == batch)
        clicks = part.where("kind = 'click'").select("ts", none.alias("entities"), none.alias("anchors"), F.lit(None).cast("double").alias("valence"), "degraded", F.col("value").alias("episodicity"))
        health_state.add_batch(health_state.memory_days(part).unionByName(health_state.recall_days(clicks)), path, batch)
        if batch == 1:
            health_state.compact(spark, path, today)
    made = health_state.report(health_state.read(spark, path, today), today)
    return made.withColumns({"before": rounded("before"), "after": rounded("after")})


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS size FROM documents""")
def backfill_overlays(spark, sf_dir):
    """Two versions of a feature, each drained over runs that stop early; the second changes a quarter of the rows."""
    path = shared_path(spark, "backfill")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    size = {1: F.col("n_chars"), 2: F.col("n_chars") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)}
    each = max(1, rows.count() // 4)
    for version in (1, 2):
        features = lambda part, v=version: part.select("id", size[v].alias("size"))
        while drains.backfill(rows, path, version, features, each, most_batches=3)["left"]:
            pass
    stored = drains.latest(spark, path, "id long, size long, digest string, changed boolean")
    changed = [drains.done(spark, path, v, "id long, size long, digest string, changed boolean").where("changed").withColumn("version", F.lit(v)) for v in (1, 2)]
    last = changed[0].unionByName(changed[1]).groupBy("id").agg(F.max("version").alias("version"))
    return stored.drop("version").join(last, "id").select("id", "version", "size")


@query("""WITH RECURSIVE d AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || '---' || chr(10)) AS t FROM documents WHERE text <> ''),
s AS (SELECT id, t, string_split(t, chr(10) || '---' || chr(10)) AS parts FROM d),
p AS (SELECT id, i, length(parts[i]) + CASE WHEN i > 1 THEN 5 ELSE 0 END AS n FROM s, unnest(range(1, len(parts) + 1)) AS r(i)),
q AS (SELECT id, i, k, least(600, n - k * 600) AS n FROM p, unnest(range(0, (n + 599) // 600)) AS r(k) WHERE n > 0),
o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, k) AS r, n FROM q),
f AS (SELECT id, r, 0 AS s, n AS e, NULL::BIGINT[] AS out FROM o WHERE r = 1
  UNION ALL SELECT f.id, o.r,
    CASE WHEN f.e + o.n - f.s <= 600 THEN f.s WHEN f.e + o.n - greatest(f.s, f.e - 60) > 600 THEN greatest(f.s, f.e - 60) + 540 ELSE greatest(f.s, f.e - 60) END, f.e + o.n,
    CASE WHEN f.e + o.n - f.s <= 600 THEN NULL WHEN f.e + o.n - greatest(f.s, f.e - 60) > 600 THEN [f.s, f.e, greatest(f.s, f.e - 60), greatest(f.s, f.e - 60) + 600] ELSE [f.s, f.e] END
  FROM f JOIN o ON o.id = f.id AND o.r = f.r + 1),
spans AS (SELECT id, r, 1 AS z, out[1] AS s, out[2] AS e FROM f WHERE out IS NOT NULL UNION ALL SELECT id, r, 2, out[3], out[4] FROM f WHERE len(out) = 4
  UNION ALL SELECT id, max(r), 9, max_by(s, r), max_by(e, r) FROM f GROUP BY id),
c AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY r, z) - 1 AS k, count(*) OVER (PARTITION BY id) AS n, s, e FROM spans)
SELECT c.id || CASE WHEN n > 1 THEN '#' || k ELSE '' END AS chunk, c.id, sha256(substring(t, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))) AS text FROM c JOIN d ON d.id = c.id""")
def turn_aware_chunks(spark, sf_dir):
    """Each line of a text is a turn; windows of 600 characters that share 60."""
    rows = facts(spark, sf_dir).select("id", F.replace("text", F.lit("\n"), F.lit("\n---\n")).alias("text"))
    return retrieval.chunk_rows(rows, 600, 60).select("chunk", "id", F.sha2("text", 256).alias("text"))


@query("""WITH c AS (SELECT doc_id AS id, unnest(range(0, 1 + doc_id % 4)) AS k, doc_id % 4 AS m FROM documents),
s AS (SELECT id, id || CASE WHEN m > 0 THEN '#' || k ELSE '' END AS chunk, ((id * 31 + k * 17) % 10) / 10.0::DOUBLE AS score FROM c)
SELECT CAST(id AS VARCHAR) AS fact, min_by(chunk, (-score, chunk)) AS chunk, max(score) AS score FROM s GROUP BY id""")
def best_chunk_per_fact(spark, sf_dir):
    n = F.col("id") % 4
    each = facts(spark, sf_dir).select("id", n.alias("m"), F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"))
    score = ((F.col("id") * 31 + F.col("k") * 17) % 10) / 10
    name = F.when(F.col("m") > 0, F.concat_ws("#", "id", "k")).otherwise(F.col("id").cast("string"))
    return retrieval.best_chunks(each.select(name.alias("chunk"), score.alias("score")))
