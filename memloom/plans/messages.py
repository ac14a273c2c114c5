"""Queries of session turns and of decoded message bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import archive
from memloom.plans.registry import query, table
from memloom.sources import sessions

_SESSION = "CASE WHEN conv_id % 2 = 0 THEN -1 ELSE conv_id END AS session, conv_id * 1000 + turn AS seq"


@query(f"""WITH m AS (SELECT {_SESSION}, CASE role WHEN 'system' THEN 'developer' ELSE role END AS role, coalesce(text, '') AS text, CAST(turn AS VARCHAR) AS ts FROM conversations),
a AS (SELECT *, count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM m),
s AS (SELECT *, lead(role) OVER w AS next, lag(role) OVER w AS before, lag(text) OVER w AS said FROM a WHERE role <> 'developer' WINDOW w AS (PARTITION BY session ORDER BY seq)),
t AS (SELECT * FROM s WHERE role = 'assistant' OR next IS DISTINCT FROM 'assistant'),
d AS (SELECT session, island, count(*) AS n FROM a WHERE role = 'developer' AND text <> '' GROUP BY ALL)
SELECT t.session, row_number() OVER (PARTITION BY t.session ORDER BY seq) - 1 AS turn_index, ts,
  sha256(CASE WHEN role = 'user' THEN text WHEN before = 'user' THEN said ELSE '' END) AS user_text, sha256(CASE WHEN role = 'assistant' THEN text ELSE '' END) AS assistant_text,
  coalesce(d.n, 0) AS developers FROM t LEFT JOIN d ON d.session = t.session AND d.island = t.island""")
def session_turns(spark, sf_dir):
    """Every other conversation belongs to one session, which so has half of the table."""
    conv = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        F.when(conv % 2 == 0, -1).otherwise(conv).alias("session"), (conv * 1000 + F.col("turn")).alias("seq"), F.col("turn").cast("string").alias("ts"),
        F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), "text",
    )
    made = sessions.pair_turns(rows)
    return made.select("session", F.col("turn_index").cast("long").alias("turn_index"), "ts", F.sha2("user_text", 256).alias("user_text"), F.sha2("assistant_text", 256).alias("assistant_text"), F.size("developer_texts").cast("long").alias("developers"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 AND text <> '' THEN sha256(text) END AS text, CASE WHEN turn % 5 = 4 THEN 'header' WHEN coalesce(text, '') = '' THEN 'length' ELSE 'ok' END AS state FROM conversations""")
def typed_stream_bodies(spark, sf_dir):
    """Turns as bodies of that form, every fifth with a damaged header."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    n = F.length(text)
    little = lambda width: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)])
    size = F.when(n < 0x81, little(1)).when(n < 65536, F.concat(F.lit("81"), little(2))).otherwise(F.concat(F.lit("82"), little(4)))
    head = F.when(F.col("turn") % 5 == 4, "050B").otherwise("040B")
    digits = F.concat(head, F.lit(archive.HEADER[4:] + "8101012B8484" + archive.MARK), size, F.hex(text), F.lit("8684012B02"))
    made = archive.decode_bodies(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.unhex(digits).alias("body")))
    return made.select("conv_id", "turn", F.sha2("decoded.text", 256).alias("text"), "decoded.state")
