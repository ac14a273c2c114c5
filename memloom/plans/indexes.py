"""The stored indexes that queries answer from: each is built once in a session for a table as it stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from memloom.operators import ann, postings
from memloom.plans.registry import facts, table
from memloom.session import shared_path

_paths: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, label: str, build: Callable[[str], None]) -> str:
    """The path of an index over table ``name``, built anew when the application or the table's length or time is another."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, label, where.toString(), fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength())
    if key not in _paths:
        path = shared_path(spark, label)
        build(path)
        _paths[key] = path
    return _paths[key]


def lexical(spark: SparkSession, sf_dir: str) -> str:
    """Postings of ``documents``."""
    return _stored(spark, sf_dir, "documents", "postings", lambda path: postings.append(facts(spark, sf_dir), path, 0))


def cells(spark: SparkSession, sf_dir: str) -> str:
    """Cells of ``embeddings``."""
    rows = lambda: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _stored(spark, sf_dir, "embeddings", "cells", lambda path: ann.build(rows(), path))
