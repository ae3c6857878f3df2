"""Tables written once and read again, in the folder that the session names for all its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Tables that a returned DataFrame may still read.
_LEFT: set[str] = set()


def package_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies in a folder they can read."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor can read. On a local master, where driver and executors are one
    process, a folder of its own is made if there is none; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="waymark-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is left there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/waymark-{tag}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_remove_left, spark)
    _LEFT.add(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing will read again."""
    for path in paths:
        _LEFT.discard(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_left(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have ended before
        remove(spark, *list(_LEFT))


def staged(df: DataFrame, tag: str) -> tuple[str, DataFrame]:
    """df as a written table, with its path, for those that remove it when they have read it."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: it is computed once, and a lost executor costs a re-read."""
    return staged(df, tag)[1]
