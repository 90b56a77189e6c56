"""Points, frames and predictions as views over the driver's tables, in Spark and in SQL.

A scene is a supplier's line items (or an embedding's label), so scenes grow in number,
not in size, as the data grow; ``point_idx`` counts within the scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_li(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the line items are dealt to: bytes of a shuffle, by which Spark joins its partitions, say little of the memory that rows need."""
    return parts_for(table(spark, sf_dir, "lineitem").count())


def points_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"l_{c}" for c in "orderkey partkey suppkey linenumber quantity extendedprice discount tax".split()]
    li = table(spark, sf_dir, "lineitem").select(*columns)
    parts = tasks_li(spark, sf_dir)
    if parts > 1:
        li = li.repartition(parts, "l_suppkey")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("scene"),
        (F.row_number().over(w) - 1).cast("long").alias("point_idx"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (F.col("l_tax") * 1000).alias("r"),
        (F.col("l_quantity") * 5).alias("g"),
        (F.floor("l_extendedprice") % 256).cast("double").alias("b"),
        F.col("l_tax").alias("strength"),
        (F.col("l_linenumber") - 2).cast("long").alias("segment"),
        (F.col("l_partkey") % 50).alias("instance"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
    )


LI = """li AS (SELECT l_suppkey AS scene, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS point_idx,
    l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax * 1000 AS r, l_quantity * 5 AS g, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS DOUBLE) AS b,
    l_tax AS strength, CAST(l_linenumber - 2 AS BIGINT) AS segment, l_partkey % 50 AS instance, l_partkey AS part, l_extendedprice AS price FROM lineitem)"""


def points_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight scenes that grow with the data; points are told apart by order and line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 8).alias("scene"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_idx"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
        (F.col("l_linenumber") - 2).cast("long").alias("segment"),
    )


BIG = """big AS (SELECT l_suppkey % 8 AS scene, l_orderkey * 8 + l_linenumber AS point_idx, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, CAST(l_linenumber - 2 AS BIGINT) AS segment FROM lineitem)"""


def _embedded(spark: SparkSession, sf_dir: str, scene, segment) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(scene.cast("long").alias("scene"), F.col("vec_id").alias("point_idx"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.slice("embedding", 4, 8).cast("array<double>").alias("feat"), segment.cast("long").alias("segment"), (F.col("vec_id") % 17).alias("instance"))


def points_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one scene."""
    return _embedded(spark, sf_dir, F.lit(0), F.col("label"))


def points_emb_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each label; segment -1 is to be ignored."""
    return _embedded(spark, sf_dir, F.col("label"), F.col("vec_id") % 4 - 1)


_EMB = "CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4:11] AS DOUBLE[]) AS feat"
EMB = f"emb AS (SELECT CAST(0 AS BIGINT) AS scene, vec_id AS point_idx, {_EMB}, CAST(label AS BIGINT) AS segment, vec_id % 17 AS instance FROM embeddings)"
EMB_S = f"emb AS (SELECT CAST(label AS BIGINT) AS scene, vec_id AS point_idx, {_EMB}, vec_id % 4 - 1 AS segment, vec_id % 17 AS instance FROM embeddings)"


def preds_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, predictions and scores; 6 classes, -1 is to be ignored."""
    p = points_li(spark, sf_dir)
    return p.select("scene", "point_idx", F.col("segment").alias("target"), (F.col("part") % 6).alias("pred"), (F.col("price") % 1000 / 1000).alias("score"), "instance", "part")


PREDS = LI + ", pr AS (SELECT scene, point_idx, segment AS target, part % 6 AS pred, price % 1000 / 1000 AS score, instance, part FROM li)"


def frames_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), "ts", "value", "event_type", "event_id")


FR = "fr AS (SELECT user_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, ts, value, event_type, event_id FROM events)"


def draw_sql(salt: str, *keys: str) -> str:
    """The same draws as :func:`pointloom.functions.expr.draw`."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{salt}', {', '.join(keys or ('scene', 'point_idx'))})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def uniform_sql(salt: str, lo: float, hi: float, *keys: str) -> str:
    return f"({lo}::DOUBLE + {hi - lo}::DOUBLE * {draw_sql(salt, *keys)})"


def normal_sql(salt: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(({draw_sql(salt + '/a', *keys)} * 4294967296.0::DOUBLE + 1) / 4294967297.0::DOUBLE)) * cos(2.0 * pi() * {draw_sql(salt + '/b', *keys)}))"


def r6(e: str, places: int = 6) -> str:
    """The same rounding as :func:`pointloom.functions.expr.r6`."""
    return f"floor(({e}) * {10**places}::DOUBLE + 0.5) / {10**places}::DOUBLE + 0.0"
