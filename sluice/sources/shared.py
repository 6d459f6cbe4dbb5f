"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, under spark.checkpoint.dir, or under a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return f"{base.rstrip('/')}/sluice-streams/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to the place of another, which is deleted."""
    delete(spark, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")
