"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.staged import package_on_workers, remove, shared_path  # noqa: F401


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver's heap next fills. A workaround: a
    driver that builds long jobs with a nearly empty heap never collects, and shuffle files pile up."""
    gc.collect()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Asks the executors to give back heap that earlier stages have grown and no longer use, before a stage whose memory is that of
    Python workers beside it. A hint: an executor that gets no task of this job keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, 2 * n, 1, 2 * n).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Bounds the batches that tasks exchange with Python while a job is planned and run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class Stage:
    """Tables written once and read many times: lineage ends at them, so a lost executor costs a
    re-read and not a recomputation. Unlike an in-memory cache they survive the executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, batch: str = "8m") -> DataFrame:
        path = shared_path(self.spark, f"{self.tag}-{name}")
        with small_batches(self.spark, batch):
            self._save(df, path, partition_by)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _save(df: DataFrame, path: str, partition_by: list[str] | None) -> None:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)

    def drop_others(self, *kept: str) -> None:
        """Drops all tables but those that the result reads."""
        self.drop(*(n for n in list(self.paths) if n not in kept))

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(n) for n in names))
        release(self.spark)


#: Rows of a list of ids or digests that are broadcast; a longer list is shuffled. A row of two numbers takes some 60 bytes
#: in a task's hash table, so a broadcast is bounded by 12 MB.
ROWS_BROADCAST = 200_000


def short(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it is short."""
    return F.broadcast(keys) if keys.count() <= ROWS_BROADCAST else keys


def without(docs: DataFrame, listed: DataFrame, same: Column, stage: Stage) -> DataFrame:
    """The rows of docs that match no row of listed, a table of keys; `same` compares the structs doc and listed,
    so that no name clashes."""
    listed = short(stage.write(listed, "listed").select(F.struct("*").alias("listed")))
    return docs.select(F.struct("*").alias("doc")).join(listed, same, "left_anti").select("doc.*")
