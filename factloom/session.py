"""Session helpers: shipping the package to executors, loading tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="factloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, where every process sees the same disk, may fall back
    to a temporary folder; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Spark's file system deletes it when it closes."""
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    handle = jvm.org.apache.hadoop.fs.Path(path)
    file_system = handle.getFileSystem(conf)
    file_system.mkdirs(handle)
    file_system.deleteOnExit(handle)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCANS = {"Project", "Filter", "Union", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD"}


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` only reads tables, row by row, so that reading it again is cheap."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _SCANS:
            return False
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    return True


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it only reads tables, else written."""
    return df if is_table(df) else written(df, name)
