"""Append-only ledgers of JSON lines: scan, count, window, lookup and append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A source event; ``raw`` keeps the source's own fields as JSON.
EVENT = "id string, ts timestamp, source string, source_msg_id string, text string, raw string"
BROKEN = "_broken"


def schema_of(ddl: str) -> StructType:
    """The declared fields and one for lines that don't parse."""
    return StructType([*StructType.fromDDL(ddl).fields, StructField(BROKEN, StringType())])


def scan(spark: SparkSession, path: str, ddl: str = EVENT) -> DataFrame:
    """Rows of all lines; a malformed line has its text in ``_broken`` and nulls elsewhere."""
    return spark.read.schema(schema_of(ddl)).option("columnNameOfCorruptRecord", BROKEN).json(path)


def parsed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def tally(rows: DataFrame) -> DataFrame:
    """(total, parsed, broken) lines."""
    broken = F.count_if(F.col(BROKEN).isNotNull())
    return rows.agg(F.count("*").alias("total"), (F.count("*") - broken).alias("parsed"), broken.alias("broken"))


def between(rows: DataFrame, start, end, kind: str | None = None) -> DataFrame:
    """Rows with ts in [start, end]; the filter reaches a Parquet scan."""
    found = rows.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return found.where(F.col("kind") == kind) if kind else found


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def sealed(rows: DataFrame) -> DataFrame:
    """Adds the checksum of all columns, by name order."""
    return rows.withColumn("checksum", F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 32))


def append(rows: DataFrame, path: str) -> None:
    """Add sealed rows as JSON lines; what is there stays."""
    sealed(rows).write.mode("append").json(path)


def unseen(rows: DataFrame, ledger: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys the ledger lacks, one for each key."""
    return rows.dropDuplicates(list(keys)).join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def voice_notes(messages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts joined to their message by (thread, stanza); one without a message is a row of its own, once."""
    one = transcripts.groupBy("thread", "stanza").agg(F.min("transcript").alias("transcript"))
    both = messages.join(one, ["thread", "stanza"], "full")
    return both.withColumn("text", F.coalesce("text", "transcript")).drop("transcript")
