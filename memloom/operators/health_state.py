"""Health that survives runs: day counts in a table, folded batch by batch and merged by addition.

A row of the state is (role, day, metric, key, value). Each micro-batch writes the folder of its own id over, so a batch that
runs again adds nothing; ``compact`` sums finished batches into one folder and leaves out old days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom import config as C
from memloom.session import complete_parts

STATE = "role string, day date, metric string, key string, value double"


def _long(rows: DataFrame, role: str, counts: dict[str, Column]) -> DataFrame:
    """Sums of the counts by UTC day of the session's zone, a row a metric."""
    wide = rows.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(*[F.sum(c.cast("double")).alias(m) for m, c in counts.items()])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0.0)).alias("value")) for m in counts])
    return wide.select(F.lit(role).alias("role"), "day", F.explode(each).alias("x")).select("role", "day", "x.metric", F.lit("").alias("key"), "x.value")


def memory_days(rows: DataFrame) -> DataFrame:
    """State rows of facts ``ts, entities, anchors, valence, episodicity, versions``, the last a map of extractor to version.

    Counted are facts, those with each feature, entities, and facts by extractor and version (the key is empty for a missing one).
    """
    has = lambda c: F.coalesce(c, F.lit(False))
    counts = {
        "rows": F.lit(1), "entities": has(F.size("entities") > 0), "anchors": has(F.size("anchors") > 0), "valence": F.col("valence").isNotNull(),
        "episodicity": F.col("episodicity").isNotNull(), "entity_tokens": F.when(F.size("entities") > 0, F.size("entities")).otherwise(0),
    }
    axes = F.map_entries(F.coalesce("versions", F.create_map().cast("map<string,string>")))
    of = rows.where("ts is not null").select(F.to_date("ts").alias("day"), F.explode(axes).alias("v"))
    versions = of.groupBy("day", F.concat(F.lit("version:"), F.col("v.key")).alias("metric"), F.coalesce("v.value", F.lit("")).alias("key")).agg(F.count("*").cast("double").alias("value"))
    return _long(rows, "memory", counts).unionByName(versions.withColumn("role", F.lit("memory")))


def recall_days(rows: DataFrame) -> DataFrame:
    """State rows of recalls ``ts, entities, anchors, valence, degraded, episodicity``."""
    has = lambda c: F.coalesce(c, F.lit(False))
    number = F.col("episodicity").isNotNull() & ~F.isnan("episodicity")
    counts = {
        "rows": F.lit(1), "entities": has(F.size("entities") > 0), "anchors": has(F.size("anchors") > 0), "valence": F.col("valence").isNotNull(),
        "degraded": has(F.col("degraded")), "episodicity": number, "episodicity_sum": F.when(number, F.col("episodicity")).otherwise(0.0),
    }
    return _long(rows, "recall", counts)


def add_batch(days: DataFrame, path: str, batch: int) -> None:
    """Write one batch's state rows over what an earlier try of it left."""
    days.select("role", "day", "metric", "key", "value").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def fold_stream(stream: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Fold each micro-batch into the state; what was read before is known from the checkpoint."""
    return stream.writeStream.foreachBatch(lambda rows, batch: add_batch(fold(rows), path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, today: Column | None = None, keep: int = C.HEALTH_KEPT) -> DataFrame:
    """The merged state: the last compacted folder and the batches after it, of the last ``keep`` days."""
    bases, batches = complete_parts(spark, path, "base"), complete_parts(spark, path, "batch")
    base = max(bases, default=-1)
    parts = [f"{path}/base={b}" for b in bases if b == base] + [f"{path}/batch={b}" for b in batches if b > base]
    rows = spark.read.schema(STATE).parquet(*parts) if parts else spark.createDataFrame([], STATE)
    if today is not None:
        rows = rows.where((F.datediff(today, "day") < keep) & (F.datediff(today, "day") >= 0))
    return rows.groupBy("role", "day", "metric", "key").agg(F.sum("value").alias("value"))


def compact(spark: SparkSession, path: str, today: Column, keep: int = C.HEALTH_KEPT) -> None:
    """Sum all finished batches into ``base=n``, n being the last one's id; batches up to it count no more."""
    batches = complete_parts(spark, path, "batch")
    if batches and max(batches) not in complete_parts(spark, path, "base"):
        read(spark, path, today, keep).write.mode("overwrite").parquet(f"{path}/base={max(batches)}")


def report(state: DataFrame, today: Column, recent: int = C.HEALTH_RECENT, baseline: int = C.HEALTH_DAYS) -> DataFrame:
    """(role, metric, before, after, level): each share of the last days against the days before, over all reducers.

    A share falls to ``warn`` when it is over DRIFT_POINTS lower and to ``critical`` at twice that; entities a fact when
    they are a tenth fewer. A version that the baseline lacks is a ``bump``. Without rows on either side the level is ``unknown``.
    """
    age = F.datediff(today, "day")
    kept = state.where((age >= 0) & (age < baseline)).withColumn("now", age < recent)
    side = lambda now: F.sum(F.when(F.col("now") == now, F.col("value")))
    sums = kept.where("key = '' and metric not like 'version:%'").groupBy("role", "metric").agg(side(False).alias("past"), side(True).alias("last"))
    rows = sums.where("metric = 'rows'").select("role", F.col("past").alias("past_rows"), F.col("last").alias("last_rows"))
    shares = sums.where("metric <> 'rows'").join(F.broadcast(rows), "role")  # a row a role
    before, after = F.try_divide("past", "past_rows"), F.try_divide("last", "last_rows")
    drop = F.round(F.col("before") - F.col("after"), 9)
    share = F.when(drop >= 2 * C.DRIFT_POINTS, "critical").when(drop > C.DRIFT_POINTS, "warn").otherwise("ok")
    fewer = F.when(F.col("after") < (1 - C.ENTITY_DROP) * F.col("before"), "warn").otherwise("ok")
    level = F.when(F.col("before").isNull() | F.col("after").isNull(), "unknown").when(F.col("metric") == "entity_tokens", fewer).when(F.col("metric").endswith("_sum"), "ok").otherwise(share)
    told = shares.select("role", "metric", before.alias("before"), after.alias("after")).withColumn("level", level)
    versions = kept.where("metric like 'version:%' and key <> ''").groupBy("role", "metric", "key").agg(F.bool_or(~F.col("now")).alias("old"), F.bool_or("now").alias("new"))
    bumps = versions.groupBy("role", "metric").agg(F.count_if("old").cast("double").alias("before"), F.count_if("new").cast("double").alias("after"), F.bool_or(F.col("new") & ~F.col("old")).alias("fresh"))
    known = F.when((F.col("before") == 0) | (F.col("after") == 0), "unknown").when(F.col("fresh"), "bump").otherwise("ok")
    return told.unionByName(bumps.select("role", "metric", "before", "after", known.alias("level")))
