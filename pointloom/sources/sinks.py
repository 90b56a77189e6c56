"""Parquet, text and JSON outputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_points(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by split and scene, points in order."""
    df.repartition("split", "scene").sortWithinPartitions("split", "scene", "point_idx").write.mode(mode).partitionBy("split", "scene").parquet(path)


def append_missing(df: DataFrame, path: str, key: str = "scene") -> None:
    """Append only scenes that the table at ``path`` does not have yet; running it twice adds nothing."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)


def submission_text(pred: DataFrame, path: str, class_ids: dict[int, int]) -> None:
    """A text file of class ids for each scene, a line for each point in order.

    Lines of a scene are written by one task, for a file is one sequence; scenes are spread.
    """
    line = F.create_map(*(F.lit(v) for kv in class_ids.items() for v in kv))[F.col("pred").cast("int")].cast("string")
    d = pred.select("scene", "point_idx", line.alias("value")).repartition("scene").sortWithinPartitions("scene", "point_idx")
    d.select("scene", "value").write.mode("overwrite").partitionBy("scene").text(path)


def top_classes_text(top: DataFrame, path: str) -> None:
    """As :func:`submission_text`, with the classes of a point on one line."""
    d = top.select("scene", "point_idx", F.col("classes").alias("value")).repartition("scene").sortWithinPartitions("scene", "point_idx")
    d.select("scene", "value").write.mode("overwrite").partitionBy("scene").text(path)


def overlap_text(pairs: DataFrame, path: str) -> None:
    pairs.select("a", "b", "ratio").write.mode("overwrite").csv(path, sep=" ")


def json_metrics(metrics: DataFrame, path: str, at: str = "iteration") -> None:
    """A JSON object for each iteration with its metrics by name."""
    d = metrics.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    d.select(F.to_json(F.map_concat(F.create_map(F.lit(at), F.col(at).cast("double")), "m")).alias("value")).write.mode("overwrite").text(path)


def label_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(scene) from a text file with one on each line."""
    return spark.read.text(path).select(F.trim("value").alias("scene")).where("scene <> ''").distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path) from a JSON list of paths."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("path"))


def write_infos(infos: DataFrame, root: str, sweeps: int = 10) -> None:
    """Sample records (nested columns as they are) by number of sweeps and ``split``; splits that ``infos`` lacks are kept."""
    infos.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{root}/sweeps={sweeps}")


def infos(spark: SparkSession, root: str, split: str | Sequence[str], sweeps: int = 10) -> DataFrame:
    """Sample records of a split, or of several one after another: one named twice comes twice.  Unknown splits have no rows."""
    names = [split] if isinstance(split, str) else list(split)
    if not names:
        raise ValueError("no split is named")
    df = spark.read.parquet(f"{root}/sweeps={sweeps}").withColumn("split", F.col("split").cast("string"))
    return reduce(DataFrame.unionByName, (df.where(F.col("split") == n) for n in names))


def named_by_path(df: DataFrame) -> DataFrame:
    """split and scene from the path of each row's file: its last two folders."""
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return df.select("*", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("scene"))
