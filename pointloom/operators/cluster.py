"""Connected components of labelled neighbour graphs, proposals and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, cell
from ..functions.shared import new_path


def _saved(df: DataFrame) -> DataFrame:
    """Written to the folder that executors share and read again, with its real size: a checkpoint keeps the estimate, which joins multiply in every round until its digits take longer than the rows."""
    path = new_path(df.sparkSession, "clusters")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame, key: Sequence[str], rounds: int = 60) -> DataFrame:
    """(key, u, root): the least node of every node's component, by alternating stars."""
    k = list(key)
    e = _saved(edges.where("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = e.select(*k, "u", "v").unionByName(e.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        # Saved minima make the join one of two plain sides, which adaptive execution can split at a hub.
        least = _saved(both.groupBy(*k, "u").agg(F.min("v").alias("m")).select(*k, "u", F.least("u", "m").alias("m")))
        large = both.join(least, [*k, "u"]).where("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _saved(large)
        m = _saved(large.groupBy(*k, "u").agg(F.min("v").alias("m")))
        small = large.join(m, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select(*k, "u", F.col("m").alias("v")))
        e = _saved(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            return e.groupBy(*k, "u").agg(F.min("v").alias("root"))
        last = now
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def components(points: DataFrame, pairs: DataFrame, threshold: int = 1, label: str | None = "segment") -> DataFrame:
    """(scene, point_idx, root, size) of points in components of at least ``threshold`` points; the root is the least point_idx.

    ``pairs`` are (scene, q, r); with a label only pairs of one label count.  Works on
    edges, not scenes, so one scene may hold a third of all points.
    """
    e = pairs.select("scene", F.col("q").alias("u"), F.col("r").alias("v"))
    if label is not None:
        of = points.select("scene", F.col("point_idx").alias("u"), F.col(label).alias("_l"))
        e = e.join(of, ["scene", "u"]).join(of.select("scene", F.col("u").alias("v"), F.col("_l").alias("_m")), ["scene", "v"]).where("_l = _m").select("scene", "u", "v")
    roots = _stars(e, ["scene"]).withColumnRenamed("u", "point_idx")
    c = points.select(*KEY).join(roots, KEY, "left").withColumn("root", F.coalesce("root", "point_idx"))
    sizes = c.groupBy("scene", "root").agg(F.count("*").alias("size")).where(F.col("size") >= threshold)
    return c.join(sizes, ["scene", "root"]).select(*KEY, "root", "size")


#: Cells' width in radii: a cell's diagonal is under 0.94, and what is within the radius is at most two cells away.
CELL = 0.54
#: Farther cells are too narrow for their coordinates' precision.
FARTHEST_CELL = 1e14
#: Two cells, or parts of them, with up to so many pairs of points are compared point by point; others are halved.
PAIRS_AT_ONCE = 1024


def _d2(d) -> Column:
    """The sum in the order of :func:`pointloom.functions.expr.dist2`."""
    return d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]


def _boxes(points: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """For each group of points their number, their box and its outermost points."""
    box = (f(c).alias(f"{e}{c}") for e, f in (("l", F.min), ("h", F.max)) for c in "xyz")
    outer = F.array_distinct(F.array(*(f(F.struct("x", "y", "z"), c) for c in "xyz" for f in (F.min_by, F.max_by))))
    return points.groupBy(*by).agg(F.count("*").alias("n"), *box, outer.alias("outer"), *more)


def _side(df: DataFrame, p: str, but: Sequence[str]) -> DataFrame:
    """The columns as those of side ``p``, its node by the side's name alone."""
    return df.withColumnsRenamed({c: p if c == "node" else f"{p}_{c}" for c in df.columns if c not in but})


def _near(both: DataFrame, radius: float) -> DataFrame:
    """Of pairs of boxes those that points within the radius may link; ``linked`` where the boxes or outermost points tell that some do.

    Rounding keeps order, so what holds for the boxes' sides holds for all distances as they are computed.
    """
    apart = {c: (F.col(f"b_l{c}") - F.col(f"a_h{c}"), F.col(f"a_l{c}") - F.col(f"b_h{c}")) for c in "xyz"}
    least, most = _d2({c: F.greatest(F.lit(0), *d) for c, d in apart.items()}), _d2({c: F.greatest(*(-v for v in d)) for c, d in apart.items()})
    outer = F.exists("a_outer", lambda a: F.exists("b_outer", lambda b: _d2({c: a[c] - b[c] for c in "xyz"}) < radius * radius))
    return both.where(least < radius * radius).withColumn("linked", (most < radius * radius) | outer)


def _neighbours(cells: DataFrame, radius: float) -> DataFrame:
    """(scene, a, b, a_n, b_n, linked) of one label's cells that points within the radius may link, each two once.

    Blocks of eight cells meet the blocks around, of two opposite ones one; a cell is one row whatever it holds.
    """
    keys = ["scene", "_l", "_x", "_y", "_z"]
    b = cells.withColumns({f"_{c}": F.shiftright(f"_{c}", 1) for c in "xyz"})
    half = [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    a = b.withColumn("to", F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("xyz", to))) for to in half))))
    a = a.withColumns({f"_{c}": F.col(f"_{c}") + F.col(f"to.{c}") for c in "xyz"})
    both = _side(a, "a", keys).join(_side(b, "b", keys), keys).where("a_to.x <> 0 OR a_to.y <> 0 OR a_to.z <> 0 OR a < b")
    return _near(both, radius).select("scene", "a", "b", "a_n", "b_n", "linked")


def _bridges(points: DataFrame, left: DataFrame, radius: float) -> DataFrame:
    """(scene, u, v): of pairs (scene, a, b, a_n, b_n, u, v) the u and v where points (scene, node, x, y, z) of a and b are within the radius.

    Few points are compared one by one.  The boxes of more are halved in all directions, and only halves that may
    hold a link go on, until none are left; so no task holds a node.
    """
    pair, part = ["scene", "u", "v"], ["scene", "node", "path"]
    points, found = points.distinct().withColumn("path", F.lit("")), []
    left = _saved(left.withColumns({"a_path": F.lit(""), "b_path": F.lit("")}))
    while True:
        of = left.select("scene", F.explode(F.array(*(F.struct(F.col(p).alias("node"), F.col(f"{p}_path").alias("path")) for p in "ab"))).alias("of"))
        points = _saved(points.join(of.select("scene", "of.*").distinct(), part, "left_semi"))
        few = F.col("a_n") * F.col("b_n") <= PAIRS_AT_ONCE
        both = left.where(few)
        for p in "ab":
            both = both.join(_side(points, p, ["scene"]), ["scene", p, f"{p}_path"])
        hit = _saved(both.where(_d2({c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"}) < radius * radius).select(*pair).distinct())
        found.append(hit)
        left = _saved(left.where(~few).join(hit, pair, "left_anti"))
        if left.isEmpty():
            break
        box = points.groupBy(*part).agg(*(f(c).alias(f"{e}{c}") for e, f in (("l", F.min), ("h", F.max)) for c in "xyz"))
        # The greatest is in the upper half even where the middle is rounded to it.
        upper = [F.expr(f"CASE WHEN {c} > l{c} + (h{c} - l{c}) / 2 OR ({c} = h{c} AND l{c} < h{c}) THEN '1' ELSE '0' END") for c in "xyz"]
        points = _saved(points.join(box, part).select("scene", "node", F.col("path").alias("above"), F.concat("path", *upper).alias("path"), "x", "y", "z"))
        halves = _saved(_boxes(points, [*part, "above"]))
        points, both = points.drop("above"), left.drop("a_n", "b_n").withColumnsRenamed({"a_path": "a_above", "b_path": "b_above"})
        for p in "ab":
            both = both.join(_side(halves, p, ["scene"]), ["scene", p, f"{p}_above"])
        both = _saved(_near(both, radius).select(*pair, "a", "b", "a_n", "b_n", "a_path", "b_path", "linked"))
        hit = both.where("linked").select(*pair).distinct()
        found.append(hit)
        left = _saved(both.where("NOT linked").drop("linked").join(hit, pair, "left_anti"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _saved(out.distinct())


def radius_components(points: DataFrame, radius: float, threshold: int = 1, label: str | None = "segment") -> DataFrame:
    """As :func:`components` over all pairs of one label nearer than the radius, which are not made: they grow with the square of a scene's density.

    Points of one label in a cell are within the radius of each other, so cells are the nodes.  Neighbouring
    cells are linked by their boxes and outermost points; where these don't tell, and the cells are not in one
    component yet, by their points (:func:`_bridges`).  Points with a null or without finite coordinates stay alone.
    """
    size, by = radius * CELL, ["scene", "_l", "_x", "_y", "_z"]
    known = F.col("_l").isNotNull()
    for c in "xyz":
        known = known & (F.abs(c) < float("inf"))
    fine = F.greatest(*(F.abs(c) for c in "xyz")) < size * FARTHEST_CELL
    at = lambda c: F.when(known & fine, cell(c, size)).when(known, F.raise_error(F.lit("coordinates too large for this radius")).cast("long"))
    p = points.where("scene IS NOT NULL AND point_idx IS NOT NULL").select(*KEY, "x", "y", "z", (F.lit(0) if label is None else F.col(label)).alias("_l"))
    p = _saved(p.withColumns({f"_{c}": at(c) for c in "xyz"}))
    cells = _saved(_boxes(p.where("_x IS NOT NULL"), by, F.min("point_idx").alias("node")))
    met = _saved(_neighbours(cells, radius))
    roots = _saved(_stars(met.where("linked").select("scene", F.col("a").alias("u"), F.col("b").alias("v")), ["scene"]))
    c = cells.select(*by, "node", "n").join(roots.withColumnRenamed("u", "node"), ["scene", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    left = met.where("NOT linked").drop("linked")
    for side in "ab":
        left = left.join(roots.select("scene", F.col("u").alias(side), F.col("root").alias(f"_{side}")), ["scene", side], "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    left = _saved(left.where("_a <> _b").select("scene", "a", "b", "a_n", "b_n", F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")))
    if not left.isEmpty():
        bridges = _bridges(p.join(cells.select(*by, "node"), by).select("scene", "node", "x", "y", "z"), left, radius)
        over = _saved(_stars(bridges, ["scene"])).select("scene", F.col("u").alias("root"), F.col("root").alias("_over"))
        c = c.join(over, ["scene", "root"], "left").withColumn("root", F.coalesce("_over", "root"))
    c = _saved(c.select(*by, "root", "n"))
    sizes = c.groupBy("scene", "root").agg(F.sum("n").alias("size"))
    c = p.select(*KEY, *by[1:]).join(c.join(sizes, ["scene", "root"]).select(*by, "root", "size"), by, "left")
    c = c.select(*KEY, F.coalesce("root", "point_idx").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    return c.where(F.col("size") >= threshold)


def number(clusters: DataFrame) -> DataFrame:
    """Clusters numbered in each scene by their least point."""
    ids = clusters.select("scene", "root").distinct()
    return clusters.join(ids.withColumn("cluster", (F.row_number().over(Window.partitionBy("scene").orderBy("root")) - 1).cast("long")), ["scene", "root"])


def proposals(points: DataFrame, radius: float, ignored: Sequence[int] = (-1,), least: int = 3, label: str = "segment", score: Column | None = None, how: str = "mean") -> DataFrame:
    """(scene, root, label, size, score): clusters of one label with more than ``least`` points and the reduced score of their members."""
    p = points.where(~F.col(label).isin(*ignored))
    c = radius_components(p, radius, 1, label).where(F.col("size") > least)
    v = p.select(*KEY, F.col(label).alias("_label"), (F.lit(1.0) if score is None else score).alias("_v"))
    reduce = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return c.join(v, KEY).groupBy("scene", "root").agg(F.min("_label").alias(label), F.count("*").alias("size"), reduce("_v").alias("score"))
