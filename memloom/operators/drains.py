"""Work that a new version asks for, drained in batches over as many runs as it takes.

The output of a version is ``version=v/round=r/batch=b``. A round fixes how many batches its work is dealt into, by the hash of the id; a batch is
written whole or not at all, so a run that broke off costs the batch in hand, and each id is worked on once a version. Rows that came
after a round was begun are the next round's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import complete_parts


def _rounds(spark: SparkSession, path: str) -> dict[int, int]:
    """Batches of each round begun."""
    return {r: spark.read.schema("batches int").json(f"{path}/plan/round={r}").first()["batches"] for r in complete_parts(spark, f"{path}/plan", "round")}


def done(spark: SparkSession, path: str, version: int, schema) -> DataFrame:
    """All rows that this version's finished batches have."""
    top = f"{path}/version={version}"
    parts = [f"{top}/round={r}/batch={b}" for r in _rounds(spark, top) for b in complete_parts(spark, f"{top}/round={r}", "batch")]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def work_set(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows whose id no finished batch has; rows without an id are none of the work."""
    return rows.where("id is not null").join(finished.select("id").distinct(), "id", "left_anti")


def drain(rows: DataFrame, path: str, version: int, work: Callable[[DataFrame], DataFrame], batch_rows: int, most_batches: int | None = None) -> dict:
    """Run ``work`` (rows with an id to rows with that id) over what this version hasn't got; at most so many batches in a run.

    ``work`` gives each id at least a row. Gives the batches written and whether any work is left. The number of batches goes with the work, at ``batch_rows`` each on average.
    """
    spark, top = rows.sparkSession, f"{path}/version={version}"
    written, before = 0, None
    while True:
        plan = _rounds(spark, top)
        now = max(plan, default=-1)
        finished = complete_parts(spark, f"{top}/round={now}", "batch") if plan else []
        waiting = [b for b in range(plan.get(now, 0)) if b not in finished]
        if not waiting:
            schema = work(rows.limit(0)).schema
            left = work_set(rows, done(spark, path, version, schema)).select("id").count()
            if not left:
                return {"written": written, "left": False}
            if left == before:
                raise ValueError(f"{left} ids have no row in what the work gave")
            before, batches = left, -(-left // batch_rows)
            spark.createDataFrame([(batches,)], "batches int").coalesce(1).write.mode("overwrite").json(f"{top}/plan/round={now + 1}")
            continue
        schema = work(rows.limit(0)).schema
        earlier = [f"{top}/round={r}/batch={b}" for r in plan if r < now for b in complete_parts(spark, f"{top}/round={r}", "batch")]
        open_rows = work_set(rows, spark.read.schema(schema).parquet(*earlier)) if earlier else rows.where("id is not null")
        for b in waiting:
            if most_batches is not None and written >= most_batches:
                return {"written": written, "left": True}
            mine = open_rows.where(F.pmod(F.xxhash64("id"), F.lit(plan[now])) == b)
            work(mine).write.mode("overwrite").parquet(f"{top}/round={now}/batch={b}")
            written += 1


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """For each id the row of the highest version that has it."""
    versions = [int(v) for v in _versions(spark, path)]
    rows = None
    for v in versions:
        part = done(spark, path, v, schema).withColumn("version", F.lit(v))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(None).cast("int"))
    best = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "version").alias("best"))
    return best.select("best.*")


def _versions(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in found)


def backfill(facts: DataFrame, path: str, version: int, features: Callable[[DataFrame], DataFrame], batch_rows: int, most_batches: int | None = None) -> dict:
    """Drain the facts through ``features`` (id to channels); ``changed`` tells rows that differ from the latest overlay before.

    Rows that don't change are kept as done and are no overlay, so that running again emits nothing.
    """
    spark = facts.sparkSession

    def work(rows: DataFrame) -> DataFrame:
        made = features(rows)
        channels = [c for c in made.columns if c != "id"]
        now = F.sha2(F.to_json(F.struct(*channels), {"ignoreNullFields": "false"}), 256)
        made = made.withColumn("digest", now)
        before = [v for v in _versions(spark, path) if v < version]
        if not before:
            return made.withColumn("changed", F.lit(True))
        schema = made.withColumn("changed", F.lit(True)).schema
        old = None
        for v in before:
            part = done(spark, path, v, schema).select("id", "digest", F.lit(v).alias("version"))
            old = part if old is None else old.unionByName(part)
        last = old.groupBy("id").agg(F.max_by("digest", "version").alias("old_digest"))
        return made.join(last, "id", "left").withColumn("changed", ~F.col("digest").eqNullSafe(F.col("old_digest"))).drop("old_digest")

    return drain(facts, path, version, work, batch_rows, most_batches)
