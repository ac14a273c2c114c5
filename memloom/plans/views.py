"""Queries of senders, paths and templates, and of memories as they are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import senders
from memloom.operators import memories
from memloom.plans.registry import query, table

_ROLES = ", ".join(f"'{r}'" for r in senders.ROLE_PARTS)


@query(f"""WITH h AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'no-reply@shop.example' WHEN 1 THEN lower(c_name) || '@mail.example' WHEN 2 THEN CAST(10000 + c_custkey % 900 AS VARCHAR) WHEN 3 THEN '+49 30 ' || c_custkey || '1234567' WHEN 4 THEN 'urn:biz:' || c_custkey
  WHEN 5 THEN 'Alerts.' || c_custkey || '@bank.example' WHEN 6 THEN 'renovate[bot]@users.example' ELSE 'info+' || c_custkey || '@x.example' END AS handle FROM customer),
l AS (SELECT *, regexp_replace(lower(regexp_extract(handle, '^([^@]+)@', 1)), '[+].*$', '') AS local FROM h),
t AS (SELECT *, regexp_replace(handle, '[ ()+.-]', '', 'g') AS digits FROM l)
SELECT id, CASE WHEN handle LIKE 'urn:biz%' OR local IN ({_ROLES}) OR replace(replace(replace(local, '.', ''), '_', ''), '-', '') IN ({_ROLES})
  OR (split_part(local, '.', 1) IN ({_ROLES}) AND regexp_matches(local, '^[a-z]+[.].*[0-9]')) OR (NOT contains(handle, '@') AND regexp_matches(digits, '^[0-9]{{3,6}}$')) THEN 'service' END AS kind,
  id % 8 = 6 AS bot FROM t""")
def sender_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    of = [F.lit("no-reply@shop.example"), F.concat(F.lower("c_name"), F.lit("@mail.example")), (10000 + k % 900).cast("string"), F.concat(F.lit("+49 30 "), k.cast("string"), F.lit("1234567")),
          F.concat(F.lit("urn:biz:"), k.cast("string")), F.concat(F.lit("Alerts."), k.cast("string"), F.lit("@bank.example")), F.lit("renovate[bot]@users.example"), F.concat(F.lit("info+"), k.cast("string"), F.lit("@x.example"))]
    handle = F.element_at(F.array(*of), (k % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), handle.alias("handle"))
    return rows.select("id", senders.sender_kind(F.col("handle")).alias("kind"), senders.is_bot(F.col("handle")).alias("bot"))


@query("""WITH e AS (SELECT l_partkey % 500 AS parent, 1000 + l_suppkey * 7 % 400 AS child FROM lineitem),
n AS (SELECT o_orderkey % 2000 AS id FROM orders GROUP BY 1),
d AS (SELECT parent AS id, list_sort(list(DISTINCT child)) AS into_ FROM e WHERE child IN (SELECT id FROM n) AND child % 3 = 0 GROUP BY parent)
SELECT n.id, CASE WHEN id % 3 = 0 THEN 'reconstructed' ELSE 'fact' END AS kind, CASE WHEN id % 5 = 0 THEN 'memory_ledger' ELSE 'mail' END AS source, CASE WHEN id % 4 = 0 THEN 'original' ELSE 'chat' END AS via,
  coalesce(array_to_string(into_, ','), '') AS derived_into, CASE WHEN id % 2 = 0 THEN 3 END AS shown FROM n LEFT JOIN d USING (id) WHERE id % 50 = 0""")
def memory_get(spark, sf_dir):
    """Events of a ledger made of orders, and their children along lines of orders: those whose id is divisible by 50."""
    i = F.col("id")
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2000).alias("id")).distinct()
    vector = F.array_repeat(F.lit(0.5), 65)
    ledger = ids.select(
        "id", F.when(i % 3 == 0, "reconstructed").otherwise("fact").alias("kind"), F.lit("text").alias("content"), F.when(i % 5 != 0, "mail").alias("source"), F.lit(None).cast("timestamp").alias("ts"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.lit(0.5).alias("confidence"), F.array(F.struct(i.cast("string").alias("ref"), F.when(i % 4 != 0, "chat").alias("via"))).alias("source_refs"), F.lit(None).cast("array<bigint>").alias("derived_from"),
        F.struct(F.when(i % 2 == 0, F.slice(vector, 1, 3)).otherwise(vector).alias("v"), F.lit("m").alias("model")).alias("features"),
    )
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("parent"), (1000 + F.col("l_suppkey") * 7 % 400).alias("child"))
    made = memories.get(ledger, ledger.where("id % 50 = 0").select("id"), edges)
    return made.select("id", "kind", F.col("provenance.source").alias("source"), F.col("source_refs")[0]["via"].alias("via"), F.array_join(F.transform("derived_into", lambda c: c.cast("string")), ",").alias("derived_into"), F.size("features.v").alias("shown"))
