"""Queries of admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import admission
from memloom.plans.registry import query, table


def _messages(spark, sf_dir):
    """Messages of five sources made out of turns, with what their rules look at."""
    c, turn = F.col("conv_id"), F.col("turn")
    source = F.element_at(F.array(*[F.lit(s) for s in ("telegram", "slack", "mail", "imessage", "pigeon")]), (c % 5 + 1).cast("int"))
    text = F.when(c % 11 == 0, F.lit("  ")).when(c % 13 == 0, F.lit("Your login code is 482913")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        c.alias("conv_id"),
        turn.alias("turn"),
        source.alias("source"),
        text.alias("text"),
        F.when(c % 7 == 0, "helper_bot").otherwise("person").alias("sender"),
        (F.col("role") == "assistant").alias("from_me"),
        F.when(c % 9 == 0, "channel").otherwise("dm").alias("peer_type"),
        F.when(turn % 4 == 3, "list-1").alias("list_id"),
        (c % 17 == 0).alias("bot"),
    )


_ADMITTED = """m AS (SELECT conv_id, turn, ['telegram', 'slack', 'mail', 'imessage', 'pigeon'][conv_id % 5 + 1] AS source,
  CASE WHEN conv_id % 11 = 0 THEN '  ' WHEN conv_id % 13 = 0 THEN 'Your login code is 482913' ELSE text END AS text,
  CASE WHEN conv_id % 7 = 0 THEN 'helper_bot' ELSE 'person' END AS sender, role = 'assistant' AS me, conv_id % 9 = 0 AS channel, turn % 4 = 3 AS listed, conv_id % 17 = 0 AS bot FROM conversations),
n AS (SELECT *, length(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS len, conv_id % 13 = 0 AND conv_id % 11 <> 0 AS code FROM m),
v AS (SELECT *, CASE
  WHEN source = 'telegram' THEN CASE WHEN sender = 'helper_bot' THEN 'DROP:bot_message' WHEN channel AND NOT me THEN 'DROP:channel_broadcast' WHEN len >= 64 THEN 'PASS::0.8' ELSE 'PASS::0.5' END
  WHEN source = 'slack' THEN CASE WHEN bot THEN 'DROP:bot_message' WHEN len = 0 THEN 'DROP:empty' WHEN len >= 25 THEN 'PASS::0.8' ELSE 'PASS::0.45' END
  WHEN source = 'mail' THEN CASE WHEN listed THEN 'DROP:list_mail' WHEN code THEN 'REDACT_DROP:otp' WHEN len < 2 THEN 'DROP:placeholder_residual' WHEN len >= 200 THEN 'PASS::0.85' ELSE 'PASS::0.4' END
  WHEN source = 'imessage' THEN CASE WHEN bot THEN 'DROP:bot_message' WHEN code AND NOT me THEN 'REDACT_DROP:otp_strict' WHEN len = 0 THEN 'DROP:placeholder' WHEN len >= 25 THEN 'PASS::0.85' ELSE 'PASS::0.4' END
  ELSE 'PASS:unknown_source:0.5' END AS x FROM n),
a AS (SELECT conv_id, turn, source, text, split_part(x, ':', 1) AS decision, nullif(split_part(x, ':', 2), '') AS reason, coalesce(try_cast(split_part(x, ':', 3) AS DOUBLE), 0.0) AS structural_score FROM v)"""


@query(f"WITH {_ADMITTED} SELECT conv_id, turn, source, decision, reason, structural_score FROM a")
def admission_verdicts(spark, sf_dir):
    return admission.admit(_messages(spark, sf_dir)).select("conv_id", "turn", "source", "decision", "reason", "structural_score")


@query(f"WITH {_ADMITTED} SELECT source, decision, reason, count(*) AS n FROM a GROUP BY 1, 2, 3")
def admission_counters(spark, sf_dir):
    return admission.counters(admission.admit(_messages(spark, sf_dir)))


@query(f"WITH {_ADMITTED} SELECT conv_id, turn, reason, sha256(coalesce(text, '')) AS checksum FROM a WHERE decision <> 'PASS'")
def quarantine_rows(spark, sf_dir):
    return admission.quarantine(admission.admit(_messages(spark, sf_dir))).select("conv_id", "turn", "reason", "checksum")
