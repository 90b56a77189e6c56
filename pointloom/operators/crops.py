"""Filters, crops, views and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, clamp, dist2, draw, normal, uniform
from .scan import all_small, least, rank_within
from .transforms import XYZ, with_scene


def crop_boundary(df: DataFrame, labels: Sequence[int] = (0, 1), column: str = "segment") -> DataFrame:
    return df.where(~F.col(column).isin(*labels))


def valid_depth(df: DataFrame, least_cos: float = 0.15, most_depth: float = 65535.0) -> DataFrame:
    """Pixels seen at an angle, with a depth and a label."""
    return df.where((F.abs("cos") > least_cos) & (F.col("depth") < most_depth) & (F.col("segment") > 0))


def valid_boxes(df: DataFrame) -> DataFrame:
    return df.where(F.col("num_lidar_pts") + F.col("num_radar_pts") > 0)


def center_of(df: DataFrame, how: str = "middle", salt: str = "center") -> DataFrame:
    """(scene, cx, cy, cz, n): the n//2-th point of each scene, or the one with the least draw."""
    rank = (F.abs(F.col("point_idx") - F.floor(F.col("_n") / 2)), F.col("point_idx")) if how == "middle" else (draw(salt), F.col("point_idx"))
    best = F.min_by(F.struct("x", "y", "z"), F.struct(*rank))
    c = with_scene(df, _n=F.count("*")).groupBy("scene").agg(best.alias("c"), F.first("_n").alias("n"))
    return c.select("scene", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"), "n")


def nearest(df: DataFrame, centers: DataFrame, k: Column, most: int | None = None, small: bool = False) -> DataFrame:
    """The ``k`` points of each scene nearest to its centre, with d2; ties by point_idx.  No scene is sorted as a whole."""
    d = df.join(centers, "scene").withColumns({"d2": dist2("x", "y", "z", "cx", "cy", "cz"), "_k": k})
    return least(d, ["scene"], "d2", "point_idx", "_k", most=most, small=small).drop("_k")


def sphere_crop(df: DataFrame, point_max: int = 80_000, sample_rate: float | None = None, mode: str = "middle", most: int | None = None) -> DataFrame:
    """In scenes with more than the limit, the nearest points to the centre, as many as the limit says."""
    c = center_of(df, "middle" if mode in ("middle", "center") else "random")
    limit = F.lit(point_max) if sample_rate is None else F.least(F.lit(point_max), F.floor(F.col("n") * sample_rate))
    return nearest(df, c, limit, most).drop("cx", "cy", "cz", "n", "d2")


def cylinder_crop(df: DataFrame, point_max: int = 80_000, radius: float = 1.0, axes: str = "xyz", mode: str = "middle") -> DataFrame:
    """In scenes with more than ``point_max`` points, those within the radius of the centre; by all axes, as a sphere, or by x and y."""
    d = df.join(center_of(df, "middle" if mode in ("middle", "center") else "random"), "scene")
    d2 = sum(((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in axes[1:]), (F.col(axes[0]) - F.col("c" + axes[0])) * (F.col(axes[0]) - F.col("c" + axes[0])))
    return d.where((F.col("n") <= point_max) | (d2 < radius * radius)).drop("cx", "cy", "cz", "n")


def assert_finite(df: DataFrame, columns: Sequence[str] = XYZ) -> DataFrame:
    """Raises when a row with a value that is not finite is read."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumn(columns[0], F.when(bad, F.raise_error(F.lit("a coordinate is not finite")).cast("double")).otherwise(F.col(columns[0])))


def split_by_range(df: DataFrame, number: str, train_below: int = 3000, val_below: int = 3250) -> DataFrame:
    return df.withColumn("split", F.when(F.col(number) < train_below, "train").when(F.col(number) < val_below, "val").otherwise("test"))


def split_by_lists(df: DataFrame, train: DataFrame, val: DataFrame, key: str = "scene") -> DataFrame:
    """By membership: train, else val, else test."""
    t, v = train.select(key).distinct().withColumn("_t", F.lit(True)), val.select(key).distinct().withColumn("_v", F.lit(True))
    return df.join(t, key, "left").join(v, key, "left").withColumn("split", F.when(F.col("_t"), "train").when(F.col("_v"), "val").otherwise("test")).drop("_t", "_v")


def two_views(df: DataFrame, salts: Sequence[str] = ("view1", "view2"), transform=None) -> DataFrame:
    """Two transformed copies of every scene, told apart by ``view``."""
    parts = [(transform(df, s) if transform else df).withColumn("view", F.lit(i + 1)) for i, s in enumerate(salts)]
    return parts[0].unionByName(parts[1])


def view(df: DataFrame, centers: DataFrame, scale=(0.1, 0.4), max_size: int = 65_536, salt: str = "view", small: bool = False) -> DataFrame:
    """The ``floor(u * min(max_size, n))`` nearest points to a centre, u drawn for the scene from ``scale``."""
    u = F.lit(float(scale[0])) + F.lit(float(scale[1] - scale[0])) * draw(salt, "scene")
    return nearest(df, centers, F.floor(u * F.least(F.lit(max_size), F.col("n"))), small=small)


def multi_view(df: DataFrame, n_global: int = 2, n_local: int = 4, global_scale=(0.4, 1.0), local_scale=(0.1, 0.4), max_size: int = 65_536, band=(0.0, 1.0), salt: str = "views") -> DataFrame:
    """(scene, point_idx, kind, view, ...): a major view, more global and local views around centres inside it.

    The major view's centre lies in a band of the scene's height.  A local view's centre is
    the point of the major view with the least draw that no earlier local view covers; where
    all are covered, that with the least draw.  The number of views is a parameter, so the
    plan grows by one top-k and one anti-join for each.
    """
    h = with_scene(df, _lo=F.min("z"), _hi=F.max("z"))
    in_band = h.where((F.col("z") >= F.col("_lo") + band[0] * (F.col("_hi") - F.col("_lo"))) & (F.col("z") <= F.col("_lo") + band[1] * (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
    sizes, small = df.groupBy("scene").agg(F.count("*").alias("n")), all_small(df, ["scene"])

    def center(points: DataFrame, s: str) -> DataFrame:
        best = points.groupBy("scene").agg(F.min_by(F.struct("x", "y", "z"), F.struct(draw(s), "point_idx")).alias("c"))
        return best.select("scene", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz")).join(sizes, "scene")

    def take(c: DataFrame, scale, s: str, kind: str, i: int) -> DataFrame:
        v = rank_within(view(df, c, scale, max_size, s, small).drop("cx", "cy", "cz", "n"), ["scene"], "d2", "point_idx", small=small)
        return v.withColumns({"rank": F.col("rank") + 1, "kind": F.lit(kind), "view": F.lit(i)})

    major = take(center(in_band, f"{salt}/major"), global_scale, f"{salt}/major/size", "global", 0)
    out = major
    for i in range(1, n_global):
        out = out.unionByName(take(center(major, f"{salt}/g{i}"), global_scale, f"{salt}/g{i}/size", "global", i))
    free = major.withColumn("covered", F.lit(0))
    for i in range(n_local):
        s = f"{salt}/l{i}"
        best = free.groupBy("scene").agg(F.min_by(F.struct("x", "y", "z"), F.struct("covered", draw(s), "point_idx")).alias("c"))
        c = best.select("scene", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz")).join(sizes, "scene")
        local = take(c, local_scale, s + "/size", "local", i)
        out = out.unionByName(local)
        free = free.join(local.select(*KEY, F.lit(1).alias("_hit")), KEY, "left").withColumn("covered", F.greatest("covered", F.coalesce("_hit", F.lit(0)))).drop("_hit")
    return out


def multi_block(df: DataFrame, n_blocks: int = 4, block_scale=(0.05, 0.15), major_scale=(0.6, 1.0), max_size: int = 65_536, overlap: bool = True, early_fuse: bool = False, salt: str = "blocks") -> DataFrame:
    """Target blocks of a major view and its context, which is the view without any target.

    Rows have kind ``target`` (with its block) or ``context``.  Without ``overlap`` a block
    takes no point of an earlier one.  With ``early_fuse`` the context is repeated for every
    block, and ``is_target`` tells the two apart.
    """
    sizes, small = df.groupBy("scene").agg(F.count("*").alias("n")), all_small(df, ["scene"])

    def center(points: DataFrame, s: str) -> DataFrame:
        best = points.groupBy("scene").agg(F.min_by(F.struct("x", "y", "z"), F.struct(draw(s), "point_idx")).alias("c"))
        return best.select("scene", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz")).join(sizes, "scene")

    major = view(df, center(df, f"{salt}/major"), major_scale, max_size, f"{salt}/size", small).drop("cx", "cy", "cz", "n", "d2")
    free, targets = major, None
    for i in range(n_blocks):
        s = f"{salt}/{i}"
        block = view(major if overlap else free, center(free, s), block_scale, max_size, s + "/size", small).drop("cx", "cy", "cz", "n", "d2").withColumn("block", F.lit(i))
        targets = block if targets is None else targets.unionByName(block)
        free = free.join(block.select(*KEY), KEY, "left_anti")
    context = major.join(targets.select(*KEY).distinct(), KEY, "left_anti")
    targets = targets.withColumn("is_target", F.lit(1))
    if early_fuse:
        context = context.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    else:
        context = context.withColumn("block", F.lit(None).cast("int"))
    return targets.unionByName(context.withColumn("is_target", F.lit(0)))


#: What a copy of a target is given: ranges of a turn about z (in pi), a scale, the chance to be mirrored in x, and the noise of its points.
AUGMENT = {"turn": (-1.0, 1.0), "scale": (0.9, 1.1), "flip": 0.5, "sigma": 0.005, "clip": 0.02}


def drawn_augments(blocks: DataFrame, copies: Sequence[str] = ("student", "teacher"), ranges: dict | None = None, salt: str = "augment") -> DataFrame:
    """(scene, block, copy, turn, scale, flip): a row of draws for each target and copy, so that no two targets of a scene are changed alike."""
    r = AUGMENT | (ranges or {})
    g = blocks.select("scene", "block").where("block is not null").distinct().withColumn("copy", F.explode(F.array(*map(F.lit, copies))))
    keys = ("scene", "block", "copy")
    return g.select(*keys, (uniform(f"{salt}/turn", *r["turn"], *keys) * math.pi).alias("turn"), uniform(f"{salt}/scale", *r["scale"], *keys).alias("scale"), (draw(f"{salt}/flip", *keys) < r["flip"]).alias("flip"))


def augmented_blocks(blocks: DataFrame, augments: DataFrame, ranges: dict | None = None, salt: str = "augment") -> DataFrame:
    """The rows of ``multi_block(early_fuse=True)`` with ``student`` and ``teacher``, arrays of the coordinates that each copy's draws make of x, y, z.

    A copy is mirrored, turned about its own centre (the middle of the block's target and context),
    scaled about it, and its points get clipped normal noise.  The draws come from the
    table ``augments``, one row for each block and copy; a copy that it lacks is null.
    """
    r = AUGMENT | (ranges or {})
    keys = ["scene", "block"]
    middle = blocks.groupBy(*keys).agg(*((F.min(c) + F.max(c)).alias(f"_m{c}") for c in "xyz"))
    drawn = augments.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("copy", F.struct("turn", "scale", "flip")))).alias("_draws"))  # a row for each copy
    d = blocks.join(middle, keys).join(drawn, keys, "left")

    def copy(name: str) -> Column:
        a = F.try_element_at("_draws", F.lit(name))
        x, y, z = (F.col(c) - F.col(f"_m{c}") / 2 for c in "xyz")
        x = F.when(a["flip"], -x).otherwise(x)
        cos, sin = F.cos(a["turn"]), F.sin(a["turn"])
        noise = [clamp(normal(f"{salt}/{name}/{c}", "scene", "block", "point_idx") * r["sigma"], -r["clip"], r["clip"]) for c in "xyz"]
        turned = (cos * x - sin * y, sin * x + cos * y, z)
        return F.when(a.isNotNull(), F.array(*(p * a["scale"] + F.col(f"_m{c}") / 2 + e for p, c, e in zip(turned, "xyz", noise)))).alias(name)

    return d.withColumns({n: copy(n) for n in ("student", "teacher")}).drop("_mx", "_my", "_mz", "_draws")
