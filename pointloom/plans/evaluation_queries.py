"""Chains of operators, and operators on rows and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import crops, losses, metrics, relational, series, spatial, transforms as t, voxel
from . import query
from .join_queries import _K, _LG, _LOVASZ, _logits, _pairs, table
from .views import EMB, EMB_S, LI, points_emb, points_emb_s, points_li, r6 as s6

XYZ = ("x", "y", "z")

_FRAGMENTS = f"""{EMB_S}, c AS (SELECT *, {", ".join(f"floor({a} / 0.1::DOUBLE) AS g{a}" for a in XYZ)} FROM emb),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, gx, gy, gz ORDER BY point_idx) - 1 AS rk, count(*) OVER (PARTITION BY scene, gx, gy, gz) AS n FROM c), m AS (SELECT *, max(n) OVER (PARTITION BY scene) AS most FROM k),
f AS (SELECT scene, point_idx, segment, CAST(f AS BIGINT) AS fragment, feat FROM m, generate_series(0, (SELECT max(most) FROM m) - 1) g(f) WHERE f < most AND f % n = rk),
lg AS (SELECT scene, point_idx, fragment, segment, CAST(i - 1 AS BIGINT) AS class, feat[i] * (1 + fragment % 3) AS logit FROM f, generate_series(1, 3) s(i)),
sm AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY scene, point_idx, fragment) AS score FROM lg),
vt AS (SELECT scene, point_idx, class, any_value(segment) AS target, sum(score) AS s FROM sm GROUP BY scene, point_idx, class),
pr AS (SELECT scene, point_idx, target, class AS pred FROM vt QUALIFY row_number() OVER (PARTITION BY scene, point_idx ORDER BY s DESC, class) = 1),
v AS (SELECT * FROM pr WHERE target BETWEEN 0 AND 2), cl AS (SELECT CAST(c AS BIGINT) AS class FROM generate_series(0, 2) s(c))"""


def _fragment_logits(spark, sf):
    """Three logits of every point in every test fragment, sharper from fragment to fragment."""
    f = voxel.fragments(points_emb_s(spark, sf), 0.1).select("scene", "point_idx", "fragment", F.posexplode(F.slice("feat", 1, 3)).alias("class", "v"))
    return f.select("scene", "point_idx", "fragment", F.col("class").cast("long").alias("class"), (F.col("v") * (1 + F.col("fragment") % 3)).alias("logit"))


def _evaluated(spark, sf):
    truth = points_emb_s(spark, sf).withColumnRenamed("segment", "target")
    return metrics.evaluate_fragments(_fragment_logits(spark, sf), truth, 3)


@query("offline_votes", f"WITH {_FRAGMENTS} SELECT scene, point_idx, pred FROM pr")
def offline_votes(spark, sf):
    return _evaluated(spark, sf)[0].select("scene", "point_idx", "pred")


@query("offline_scene_iou", f"WITH {_FRAGMENTS}, a AS (SELECT scene, class, count(*) FILTER (WHERE target = class AND pred = class) AS i, count(*) FILTER (WHERE pred = class OR target = class) AS u FROM v, cl GROUP BY scene, class) SELECT scene, {s6('avg(i / (u + 1e-10))')} AS iou FROM a WHERE u > 0 GROUP BY scene")
def offline_scene_iou(spark, sf):
    return _evaluated(spark, sf)[1].select("scene", r6("iou").alias("iou"))


@query("offline_metrics", f"WITH {_FRAGMENTS}, a AS (SELECT class, count(*) FILTER (WHERE target = class AND pred = class) AS i, count(*) FILTER (WHERE pred = class) AS p, count(*) FILTER (WHERE target = class) AS t FROM v, cl GROUP BY class) SELECT {s6('avg(i / (p + t - i + 1e-10))')} AS miou, {s6('avg(i / (t + 1e-10))')} AS macc, {s6('sum(i) / (sum(t) + 1e-10)')} AS allacc FROM a")
def offline_metrics(spark, sf):
    return _evaluated(spark, sf)[2].select(*(r6(c).alias(c) for c in ("miou", "macc", "allacc")))


@query("criteria", f"WITH {_LG}, e AS (SELECT class, scene, point_idx, (class = target)::INT::DOUBLE AS fg, abs((class = target)::INT - exp(logp)) AS error FROM sm), {_LOVASZ}, l AS (SELECT class, sum(error * step) AS l FROM t GROUP BY class) SELECT {s6('(SELECT avg(-logp) FROM sm WHERE class = target) + 0.5::DOUBLE * (SELECT avg(l) FROM l)')} AS loss")
def criteria(spark, sf):
    return losses.criteria((1.0, losses.cross_entropy(_logits(spark, sf), _K)), (0.5, losses.lovasz_softmax(_logits(spark, sf), _K))).select(r6("loss").alias("loss"))


@query("ball_group", f"""WITH {EMB}, {_pairs(0.15)}, f AS (SELECT *, row_number() OVER (PARTITION BY scene, q ORDER BY d2, r) - 1 AS rk, count(*) OVER (PARTITION BY scene, q) AS n FROM pairs WHERE d2 <= 1e-5 OR d2 >= 0.0004),
b AS (SELECT q, r, rk AS slot FROM f WHERE n <= 8 UNION ALL SELECT q, r, CAST(i AS BIGINT) FROM f, generate_series(0, 7) s(i) WHERE n > 8 AND rk = n * i // 8)
SELECT q, slot, r, {s6('y.x - x.x')} AS rel_x, {s6('y.y - x.y')} AS rel_y, {s6('y.z - x.z')} AS rel_z, {s6('y.feat[3]')} AS f3 FROM b JOIN emb x ON x.point_idx = q JOIN emb y ON y.point_idx = r""")
def ball_group(spark, sf):
    p = points_emb(spark, sf)
    g = spatial.group(spatial.ball_query(p, p, 0.15, 8, 0.02), p, queries=p)
    return g.select("q", "slot", "r", *(r6(f"rel_{c}").alias(f"rel_{c}") for c in XYZ), r6(F.element_at("feat", 3)).alias("f3"))


@query("subm_conv_wide", f"""WITH {EMB_S}, c AS (SELECT DISTINCT scene, {", ".join(f"CAST(floor({a} / 0.1::DOUBLE) AS BIGINT) AS g{a}" for a in XYZ)} FROM emb),
v AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY gx, gy, gz) - 1 AS id FROM c)
SELECT a.scene, a.id AS out, CAST(((b.gx - a.gx + 2) * 5 + b.gy - a.gy + 2) * 5 + b.gz - a.gz + 2 AS INT) AS "offset", b.id AS "in" FROM v a JOIN v b ON a.scene = b.scene AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 AND abs(a.gz - b.gz) <= 2""")
def subm_conv_wide(spark, sf):
    """Kernel pairs of five cells along each axis."""
    return relational.convolution_pairs(voxel.voxel_ids(voxel.cells(points_emb_s(spark, sf), 0.1)), 5)


@query("overlapping_scenes", f"""WITH {EMB_S}, m AS (SELECT scene, floor(x / 0.1::DOUBLE) AS vx, floor(y / 0.1::DOUBLE) AS vy, floor(z / 0.1::DOUBLE) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM emb GROUP BY 1, 2, 3, 4),
h AS (SELECT a.scene AS a, b.scene AS b, count(DISTINCT (a.vx, a.vy, a.vz)) AS k FROM m a JOIN m b ON a.scene <> b.scene AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0225 GROUP BY 1, 2), n AS (SELECT scene, count(*) AS n FROM m GROUP BY 1)
SELECT least(a, b) AS a, greatest(a, b) AS b FROM h JOIN n ON n.scene = h.a GROUP BY 1, 2 HAVING max(k / n) >= 0.75""")
def overlapping_scenes(spark, sf):
    return spatial.overlapping(spatial.overlap_ratios(points_emb_s(spark, sf), 0.1), 0.75).select("a", "b")


@query("frame_order", "WITH p AS (SELECT '/s' || user_id || '/' || event_id || CASE WHEN event_type = 'click' THEN 'x' ELSE '' END || '.jpg' AS path, user_id, event_id FROM events) SELECT path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no FROM p WHERE path NOT LIKE '%x.jpg'")
def frame_order(spark, sf):
    e = table(spark, sf, "events")
    p = e.select(F.concat(F.lit("/s"), "user_id", F.lit("/"), "event_id", F.when(F.col("event_type") == "click", "x").otherwise(""), F.lit(".jpg")).alias("path"))
    return series.frame_order(p).select("path", "frame_no")


@query("unpool_concat", f"""WITH {EMB_S}, c AS (SELECT scene, point_idx, feat, {", ".join(f"CAST(floor({a} / 0.05::DOUBLE) AS BIGINT) - min(CAST(floor({a} / 0.05::DOUBLE) AS BIGINT)) OVER (PARTITION BY scene) AS g{a}" for a in XYZ)} FROM emb),
k AS (SELECT scene, gx // 2 AS hx, gy // 2 AS hy, gz // 2 AS hz, max(feat[1]) AS p1 FROM c GROUP BY ALL)
SELECT c.scene, point_idx, {s6('feat[8]')} AS own, {s6('p1')} AS parent FROM c JOIN k ON k.scene = c.scene AND hx = gx // 2 AND hy = gy // 2 AND hz = gz // 2""")
def unpool_concat(spark, sf):
    c = voxel.cells(points_emb_s(spark, sf), 0.05)
    up = voxel.grid_unpool(c, voxel.grid_pool(c), concat=True)
    return up.select("scene", "point_idx", r6(F.element_at("feat", 8)).alias("own"), r6(F.element_at("feat", 9)).alias("parent"))


@query("valid_depth", f"WITH {LI} SELECT scene, point_idx FROM li WHERE abs(z / 10) > 0.15 AND price < 65535.0 AND segment > 0")
def valid_depth(spark, sf):
    p = points_li(spark, sf).withColumns({"cos": F.col("z") / 10, "depth": F.col("price")})
    return crops.valid_depth(p).select("scene", "point_idx")


@query("valid_boxes", f"WITH {LI} SELECT scene, point_idx FROM li WHERE part % 3 + instance % 2 > 0")
def valid_boxes(spark, sf):
    p = points_li(spark, sf).withColumns({"num_lidar_pts": F.col("part") % 3, "num_radar_pts": F.col("instance") % 2})
    return crops.valid_boxes(p).select("scene", "point_idx")


@query("split_by_lists", "SELECT s_suppkey AS scene, CASE WHEN s_suppkey IN (SELECT c_custkey * 3 FROM customer) THEN 'train' WHEN s_suppkey IN (SELECT c_custkey * 2 FROM customer) THEN 'val' ELSE 'test' END AS split FROM supplier")
def split_by_lists(spark, sf):
    c = table(spark, sf, "customer")
    return crops.split_by_lists(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene")), c.select((F.col("c_custkey") * 3).alias("scene")), c.select((F.col("c_custkey") * 2).alias("scene")))


@query("select_rows", f"WITH {LI} SELECT scene, point_idx, strength AS was, 7 AS kind, CAST(x AS FLOAT) AS x FROM li WHERE segment = 1")
def select_rows(spark, sf):
    """Points by key, a column copied, one set, and numbers as a tensor's."""
    p = points_li(spark, sf)
    rest = t.select_rows(p, p.where("segment <> 1 or segment is null"), keep=False)
    d = t.update(t.copy_columns(t.select_rows(p, rest), {"strength": "was"}), kind=7)
    as_tensor = t.to_tensor(d.select("scene", "point_idx", "x"))
    return d.select("scene", "point_idx", "was", "kind").join(as_tensor, ["scene", "point_idx"]).select("scene", "point_idx", "was", "kind", "x")


@query("box_sizes", f"WITH {LI} SELECT scene, point_idx, {s6('y')} AS s0, {s6('x')} AS s1, {s6('z')} AS s2 FROM li")
def box_sizes(spark, sf):
    p = t.lwh(points_li(spark, sf).select("scene", "point_idx", F.col("x").alias("w"), F.col("y").alias("l"), F.col("z").alias("h")))
    return p.select("scene", "point_idx", *(r6(F.element_at("size", i + 1)).alias(f"s{i}") for i in range(3)))
