"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may lack that setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="memloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    A lost executor costs the tasks it ran, never a recomputation from the start.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` alone, null text as empty: other columns can't clash."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches, limit: int = 4 << 20):
    """The batches, cut so that no part holds much more than ``limit`` bytes unless one row does."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
