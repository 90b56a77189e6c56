"""Voxel grids: cells, samples, fragments, keys, pooling, mixing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, cell, draw
from .scan import prefix
from .transforms import XYZ, with_scene

CELL = ("gx", "gy", "gz")


def cells(df: DataFrame, size: float, scene: str = "scene") -> DataFrame:
    """With gx, gy, gz: the cells of the coordinates, from 0 in each scene."""
    c = df.withColumns({g: cell(x, size) for g, x in zip(CELL, XYZ)})
    c = with_scene(c, by=(scene,), **{f"_l{g}": F.min(g) for g in CELL})
    return c.withColumns({g: F.col(g) - F.col(f"_l{g}") for g in CELL}).drop(*(f"_l{g}" for g in CELL))


def downsample(df: DataFrame, size: float, labels: str = "segment") -> DataFrame:
    """Per voxel its points, lowest point_idx, mean coordinates and most frequent label (the least of equals)."""
    c = cells(df, size)
    per_label = c.groupBy("scene", *CELL, labels).agg(F.count("*").alias("k"), F.min("point_idx").alias("p"), *(F.sum(x).alias(f"s{x}") for x in XYZ))
    return per_label.groupBy("scene", *CELL).agg(F.sum("k").alias("n"), F.min("p").alias("rep"), *((F.sum(f"s{x}") / F.sum("k")).alias(x) for x in XYZ), F.max_by(labels, F.struct("k", -F.col(labels))).alias(labels))


def voxel_ids(df: DataFrame, parts: int = 1) -> DataFrame:
    """(scene, gx, gy, gz, voxel_id): the voxels of each scene numbered in the order of their cells; by ``parts`` tasks if more than one."""
    v = df.select("scene", *CELL).distinct()
    v = v.repartition(parts, "scene") if parts > 1 else v
    return v.withColumn("voxel_id", (F.row_number().over(Window.partitionBy("scene").orderBy(*CELL)) - 1).cast("long"))


def sample_train(df: DataFrame, size: float, labeled: str | None = None, salt: str = "voxel") -> DataFrame:
    """One point of each voxel, that with the least draw, and every labelled point; with cells and displacement from the cell's centre."""
    c = cells(df, size)
    w = Window.partitionBy("scene", *CELL).orderBy(draw(salt), "point_idx")
    keep = F.row_number().over(w) == 1
    c = c.withColumn("_keep", keep if labeled is None else keep | F.col(labeled)).where("_keep").drop("_keep")
    return displaced(c, size)


def displaced(df: DataFrame, size: float, normals: Sequence[str] | None = None) -> DataFrame:
    """Displacements from the cells' centres in cells; with normals, their product with them."""
    d = [F.col(x) / size - cell(x, size) - 0.5 for x in XYZ]
    if normals:
        return df.withColumn("displacement", d[0] * F.col(normals[0]) + d[1] * F.col(normals[1]) + d[2] * F.col(normals[2]))
    return df.withColumns({f"d{x}": e for x, e in zip(XYZ, d)})


def inverse(df: DataFrame, size: float, parts: int = 1) -> DataFrame:
    """(scene, point_idx, voxel_id) of every point; by ``parts`` tasks if more than one, else as Spark deals them."""
    c = cells(df, size).select(*KEY, *CELL)
    c = c.repartition(parts, "scene", *CELL) if parts > 1 else c
    return c.join(voxel_ids(c, parts), ["scene", *CELL]).select(*KEY, "voxel_id")


def fragments(df: DataFrame, size: float) -> DataFrame:
    """Test fragments: as many as the fullest voxel of the scene has points; fragment i takes member i mod count of each voxel."""
    c = cells(df, size)
    w = Window.partitionBy("scene", *CELL)
    c = c.withColumns({"_rank": (F.row_number().over(w.orderBy("point_idx")) - 1).cast("long"), "_n": F.count("*").over(w)})
    c = with_scene(c, _most=F.max("_n"))
    # Member r of n is in the fragments r, r+n, r+2n, ...
    return c.withColumn("fragment", F.explode(F.sequence("_rank", F.col("_most") - 1, F.col("_n")))).drop("_rank", "_n", "_most")


def ravel_key(df: DataFrame, size: float) -> DataFrame:
    """Cells as one number, row by row over the scene's extent."""
    c = with_scene(cells(df, size), _ny=F.max("gy") + 1, _nz=F.max("gz") + 1)
    return c.withColumn("key", (F.col("gx") * F.col("_ny") + F.col("gy")) * F.col("_nz") + F.col("gz")).drop("_ny", "_nz")


#: 64-bit FNV constants.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv_key(df: DataFrame, size: float) -> DataFrame:
    """64-bit FNV over whole coordinates (multiply, then xor), as an unsigned decimal, by Arrow batches with wrapping integers."""

    @F.pandas_udf("decimal(20,0)")
    def fnv(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        from decimal import Decimal

        import numpy as np

        h = np.full(len(x), FNV_OFFSET, np.uint64)
        for c in (x, y, z):
            h = (h * np.uint64(FNV_PRIME)) ^ c.to_numpy(np.int64).view(np.uint64)
        return pd.Series([Decimal(int(v)) for v in h])

    return cells(df, size).withColumn("key", fnv(*CELL))


def dedupe_lowest(df: DataFrame, size: float) -> DataFrame:
    """The point with the lowest point_idx of each cell."""
    c = df.withColumns({g: cell(x, size) for g, x in zip(CELL, XYZ)})
    first = c.groupBy("scene", *CELL).agg(F.min("point_idx").alias("point_idx"))
    return df.join(first.select(*KEY), KEY, "left_semi")


def _reduce(how: str, c: Column) -> Column:
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](c)


def grid_pool(df: DataFrame, stride: int = 2, feature: str = "feat", width: int = 8, reduce: str = "max", mean: Sequence[str] = XYZ) -> DataFrame:
    """Cells divided by the stride: per coarse cell reduced features (an array of ``width``), mean columns and a count."""
    coarse = [F.floor(F.col(g) / stride).cast("long").alias(g) for g in CELL]
    d = df.select("scene", *coarse, *mean, *(F.element_at(feature, i + 1).alias(f"_f{i}") for i in range(width)))
    p = d.groupBy("scene", *CELL).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in mean), *(_reduce(reduce, F.col(f"_f{i}")).alias(f"_f{i}") for i in range(width)))
    return p.withColumn(feature, F.array(*(F.col(f"_f{i}") for i in range(width)))).drop(*(f"_f{i}" for i in range(width)))


def grid_unpool(df: DataFrame, pooled: DataFrame, stride: int = 2, feature: str = "feat", concat: bool = False) -> DataFrame:
    """Points with their coarse cell's features added to their own, or appended to them."""
    parent = pooled.select("scene", *(F.col(g).alias(f"_{g}") for g in CELL), F.col(feature).alias("_parent"))
    d = df.withColumns({f"_{g}": F.floor(F.col(g) / stride).cast("long") for g in CELL}).join(parent, ["scene", *(f"_{g}" for g in CELL)])
    both = F.concat(feature, "_parent") if concat else F.zip_with(feature, "_parent", lambda a, b: a + b)
    return d.withColumn(feature, both).drop("_parent", *(f"_{g}" for g in CELL))


def mix_scenes(df: DataFrame, instance: str = "instance", p: float = 1.0, salt: str = "mix") -> DataFrame:
    """Neighbouring scenes merged in pairs, with ``mix_id``; instances of the second move beyond those of the first.

    Scenes are ranked over one narrow row for each; a pair is merged with probability p.
    """
    s = df.groupBy("scene").agg(F.max(instance).alias("_top"))
    s = prefix(s, "scene", rank="_rank").withColumn("_pair", F.floor(F.col("_rank") / 2))
    first = s.where("_rank % 2 = 0").select("_pair", F.col("_top").alias("_shift"))
    s = s.join(first, "_pair").withColumn("_on", draw(salt, "_pair") < p)
    s = s.select("scene", F.when(F.col("_on"), F.col("_pair") * 2).otherwise(F.col("_rank")).alias("mix_id"), F.when(F.col("_on") & (F.col("_rank") % 2 == 1), F.greatest("_shift", F.lit(-1)) + 1).otherwise(F.lit(0)).alias("_shift"))
    return df.join(s, "scene").withColumn(instance, F.when(F.col(instance) >= 0, F.col(instance) + F.col("_shift")).otherwise(F.col(instance))).drop("_shift")


def fan_back(predictions: DataFrame, inverse_map: DataFrame, keep=("pred",)) -> DataFrame:
    """Predictions of voxels (scene, voxel_id, ...) at every point of :func:`inverse`."""
    return inverse_map.join(predictions.select("scene", "voxel_id", *keep), ["scene", "voxel_id"]).select(*KEY, *keep)
