"""Long evaluations that go on where they were interrupted."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def committed(spark: SparkSession, path: str) -> list[str]:
    """The batches below ``path`` that were written to their end, by the mark that Spark's commit leaves."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = [s.getPath() for s in system.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch-")]
    return sorted(p.toString() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches; what a broken run left is not read."""
    paths = committed(spark, path)
    return reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in paths)) if paths else None


def resumed(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "scene", batches: int = 8) -> DataFrame:
    """``compute`` over all of ``df``, batch by batch of keys, each committed with its results.

    Keys that a committed batch has results of are not computed again; so after an
    interruption, or when keys were added, a call does what is left and returns the results of
    both.  ``compute`` treats keys apart from each other and returns the key with its rows.
    Keys without any row of results are computed each time.  Null keys are left out.
    """
    spark = df.sparkSession
    left = df.where(F.col(key).isNotNull())
    done = results(spark, path)
    if done is not None:
        left = left.join(done.select(key).distinct(), key, "left_anti")
    for i in range(batches):
        part = left.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        if not part.isEmpty():
            compute(part).write.parquet(f"{path.rstrip('/')}/batch-{uuid.uuid4().hex}")
    out = results(spark, path)
    return compute(left.where("false")) if out is None else out
