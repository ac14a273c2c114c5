"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once for each application; those that have it installed lose nothing."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="memloom-"), "memloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent).as_posix())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, with the settings that results depend on."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("memloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        build = build.config(k, v)
    return ship_package(build.getOrCreate())


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; only a local session may lack its setting."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="memloom-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that plans end there and lost executors cost their tasks only."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def complete_parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of folders ``name=n`` under ``path`` whose write was completed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage where the session has a checkpoint folder, so that plans of loops stay short."""
    sc = df.sparkSession.sparkContext
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="memloom-"))
    return df.checkpoint()
