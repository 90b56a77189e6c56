"""Scenes that grow with the data, by the plans for scenes of any size: no task holds one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crops, curve, scan, spatial, transforms as t, voxel
from . import query
from .views import BIG, draw_sql, points_big, points_emb_s
from .join_queries import _fps_sql

#: So few rows are left to one task here that the plans for large scenes run on the smallest tables too.
_MOST = 100
_CENTER = """m AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY point_idx) - 1 AS k, count(*) OVER (PARTITION BY scene) AS n FROM big),
c AS (SELECT scene, x AS cx, y AS cy, z AS cz, n FROM m WHERE k = n // 2)"""
_D2 = "(big.x - cx) * (big.x - cx) + (big.y - cy) * (big.y - cy) + (big.z - cz) * (big.z - cz)"


def _numbered(spark, sf):
    """Big scenes with points numbered from 0, by the prefix ranks."""
    return scan.rank_within(points_big(spark, sf), ["scene"], "point_idx", rank="n", most=_MOST).drop("point_idx").withColumnRenamed("n", "point_idx")


@query("scene_numbers", f"WITH {BIG} SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY point_idx) - 1 AS point_idx, segment FROM big")
def scene_numbers(spark, sf):
    return _numbered(spark, sf).select("scene", "point_idx", "segment")


@query("scene_crop", f"WITH {BIG}, {_CENTER}, k AS (SELECT big.scene, big.point_idx, row_number() OVER (PARTITION BY big.scene ORDER BY {_D2}, big.point_idx) AS rk, n FROM big JOIN c ON c.scene = big.scene) SELECT scene, point_idx FROM k WHERE rk <= floor(n * 0.3::DOUBLE)")
def scene_crop(spark, sf):
    """The nearest three tenths of each scene to its middle point, by refined histograms.

    Of points with one point_idx in the middle, which the SQL leaves open, the coordinates decide.
    """
    p = points_big(spark, sf)
    numbered = scan.rank_within(p, ["scene"], "point_idx", "x", "y", "z", rank="k", most=_MOST)
    sizes = p.groupBy("scene").count()
    c = numbered.join(sizes, "scene").where("k = floor(count / 2)").selectExpr("scene", "x as cx", "y as cy", "z as cz", "count as n")
    return crops.nearest(p, c, F.floor(F.col("n") * 0.3), _MOST).select("scene", "point_idx")


@query("scene_dropout", f"""WITH {BIG}, k AS (SELECT scene, point_idx, row_number() OVER (PARTITION BY scene ORDER BY {draw_sql('dropout')}, point_idx) AS rk, count(*) OVER (PARTITION BY scene) AS n FROM big)
SELECT scene, point_idx FROM k WHERE {draw_sql('dropout/scene', 'scene')} >= 0.7 OR rk <= floor(n * (1 - 0.2::DOUBLE))""")
def scene_dropout(spark, sf):
    return t.random_dropout(points_big(spark, sf), apply=0.7, most=_MOST).select("scene", "point_idx")


@query("scene_shuffle", f"WITH {BIG} SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY {draw_sql('shuffle')}, point_idx) - 1 AS point_idx, point_idx AS old_idx FROM big")
def scene_shuffle(spark, sf):
    return t.shuffle(points_big(spark, sf), most=_MOST).select("scene", "point_idx", "old_idx")


_ORDERS = curve.drawn_orders(("z", "z-trans"), "orders")
_G = ", ".join(f"CAST(floor({c} / 0.5) AS BIGINT) - min(CAST(floor({c} / 0.5) AS BIGINT)) OVER (PARTITION BY scene) AS g{c}" for c in "xyz")
_CODE = "list_sum(list_transform(range(16), lambda i: (({0} >> i & 1) << (3 * i + 2)) + (({1} >> i & 1) << (3 * i + 1)) + ((gz >> i & 1) << (3 * i))))"


def _codes(order: str) -> str:
    return _CODE.format("gy", "gx") if order.endswith("-trans") else _CODE.format("gx", "gy")


@query("scene_orders", f"""WITH {BIG}, g AS (SELECT scene, point_idx, {_G} FROM big), c AS (SELECT scene, point_idx, {', '.join(f'{_codes(o)} AS c{i}' for i, o in enumerate(_ORDERS))} FROM g)
SELECT scene, point_idx, row_number() OVER (PARTITION BY scene ORDER BY c0, point_idx) - 1 AS rank_0, row_number() OVER (PARTITION BY scene ORDER BY c1, point_idx) - 1 AS rank_1 FROM c""")
def scene_orders(spark, sf):
    """Ranks on two curves whose order is drawn."""
    cells = voxel.cells(points_big(spark, sf), 0.5)
    return curve.serialize(cells, ("z", "z-trans"), shuffle="orders", most=_MOST).select("scene", "point_idx", "rank_0", "rank_1")


@query("scene_fps", _fps_sql(12))
def scene_fps(spark, sf):
    """Farthest points by cells and rounds."""
    return spatial.farthest_points(points_emb_s(spark, sf), 12, most=0)
