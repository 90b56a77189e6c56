"""Queries over points: transforms, crops, voxels, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import from_gray, r6, to_gray
from ..operators import crops, curve, transforms as t, voxel
from . import query
from .views import EMB, EMB_S, LI, draw_sql, normal_sql, points_emb, points_emb_s, points_li, r6 as s6, tasks_li, uniform_sql

XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")


def _out(df, *columns, keep=()):
    return df.select("scene", "point_idx", *keep, *(r6(c).alias(c) for c in columns))


def _sel(source: str, keep: str = "", **columns: str) -> str:
    return f"SELECT scene, point_idx, {keep}{', '.join(f'{s6(e)} AS {c}' for c, e in columns.items())} FROM {source}"


# Voxels

_CELLS = {g: f"CAST(floor({c} / {{s}}) AS BIGINT) - min(CAST(floor({c} / {{s}}) AS BIGINT)) OVER (PARTITION BY scene) AS {g}" for g, c in zip(("gx", "gy", "gz"), XYZ)}


def _cells(size: float, view: str = "emb") -> str:
    return f"c AS (SELECT *, {', '.join(v.format(s=size) for v in _CELLS.values())} FROM {view})"


@query("voxel_downsample", f"""
WITH {EMB}, {_cells(0.1)}, l AS (SELECT scene, gx, gy, gz, segment, count(*) AS k FROM c GROUP BY ALL),
m AS (SELECT scene, gx, gy, gz, arg_max(segment, k * 1000 - segment) AS segment FROM l GROUP BY ALL)
SELECT scene, gx, gy, gz, count(*) AS n, min(point_idx) AS rep, {s6('avg(x)')} AS x, {s6('avg(y)')} AS y, {s6('avg(z)')} AS z, any_value(m.segment) AS segment
FROM c JOIN m USING (scene, gx, gy, gz) GROUP BY scene, gx, gy, gz""")
def voxel_downsample(spark, sf):
    d = voxel.downsample(points_emb(spark, sf), 0.1)
    return d.select("scene", "gx", "gy", "gz", "n", "rep", *(r6(c).alias(c) for c in XYZ), "segment")


@query("voxel_inverse", f"""
WITH {LI}, {_cells(2.0, 'li')}
SELECT scene, point_idx, dense_rank() OVER (PARTITION BY scene ORDER BY gx, gy, gz) - 1 AS voxel_id FROM c""")
def voxel_inverse(spark, sf):
    return voxel.inverse(points_li(spark, sf), 2.0, tasks_li(spark, sf))


@query("voxel_sample", f"""
WITH {LI}, {_cells(2.0, 'li')}, k AS (SELECT *, row_number() OVER (PARTITION BY scene, gx, gy, gz ORDER BY {draw_sql('voxel')}, point_idx) AS rk FROM c)
SELECT scene, point_idx, gx, gy, gz, {s6('x / 2 - floor(x / 2) - 0.5')} AS dx, {s6('y / 2 - floor(y / 2) - 0.5')} AS dy, {s6('z / 2 - floor(z / 2) - 0.5')} AS dz FROM k WHERE rk = 1 OR segment = 0""")
def voxel_sample(spark, sf):
    d = voxel.sample_train(points_li(spark, sf).withColumn("labeled", F.col("segment") == 0), 2.0, "labeled")
    return d.select("scene", "point_idx", "gx", "gy", "gz", *(r6(c).alias(c) for c in ("dx", "dy", "dz")))


@query("voxel_fragments", f"""
WITH {EMB_S}, {_cells(0.1)}, k AS (SELECT scene, point_idx, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY scene, gx, gy, gz) AS n FROM c WINDOW w AS (PARTITION BY scene, gx, gy, gz ORDER BY point_idx)),
m AS (SELECT *, max(n) OVER (PARTITION BY scene) AS most FROM k)
SELECT scene, point_idx, CAST(f AS BIGINT) AS fragment FROM m, generate_series(0, (SELECT max(most) FROM m) - 1) g(f) WHERE f < most AND f % n = rk""")
def voxel_fragments(spark, sf):
    return voxel.fragments(points_emb_s(spark, sf), 0.1).select("scene", "point_idx", "fragment")


@query("voxel_ravel_key", f"""
WITH {LI}, {_cells(2.0, 'li')}
SELECT scene, point_idx, (gx * (max(gy) OVER w + 1) + gy) * (max(gz) OVER w + 1) + gz AS key FROM c WINDOW w AS (PARTITION BY scene)""")
def voxel_ravel_key(spark, sf):
    return voxel.ravel_key(points_li(spark, sf), 2.0).select("scene", "point_idx", "key")


def _fnv(h: str, c: str) -> str:
    return f"xor(({h} * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, CAST({c} AS UHUGEINT))"


@query("voxel_fnv_key", f"""
WITH {LI}, {_cells(2.0, 'li')}
SELECT scene, point_idx, CAST({_fnv(_fnv(_fnv('14695981039346656037::UHUGEINT', 'gx'), 'gy'), 'gz')} AS VARCHAR) AS key FROM c""")
def voxel_fnv_key(spark, sf):
    return voxel.fnv_key(points_li(spark, sf), 2.0).select("scene", "point_idx", F.col("key").cast("string").alias("key"))


@query("structured_dedupe", f"""
WITH {LI} SELECT scene, min(point_idx) AS point_idx FROM li GROUP BY scene, floor(x / 5), floor(y / 5), floor(z / 5)""")
def structured_dedupe(spark, sf):
    return voxel.dedupe_lowest(points_li(spark, sf), 5.0).select("scene", "point_idx")


_POOL = f"{_cells(0.05)}, p AS (SELECT scene, gx // 2 AS gx, gy // 2 AS gy, gz // 2 AS gz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, {', '.join(f'max(feat[{i}]) AS f{i}' for i in range(1, 9))} FROM c GROUP BY 1, 2, 3, 4)"


@query("grid_pool", f"""
WITH {EMB_S}, {_POOL} SELECT scene, gx, gy, gz, n, {', '.join(f'{s6(c)} AS {c}' for c in XYZ)}, {s6(' + '.join(f'f{i} * {i}' for i in range(1, 9)))} AS feat_sum FROM p""")
def grid_pool(spark, sf):
    p = voxel.grid_pool(voxel.cells(points_emb_s(spark, sf), 0.05))
    return p.select("scene", "gx", "gy", "gz", "n", *(r6(c).alias(c) for c in XYZ), r6(_weighted("feat")).alias("feat_sum"))


def _weighted(feat: str):
    return F.aggregate(F.transform(feat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)


@query("grid_unpool", f"""
WITH {EMB_S}, {_POOL} SELECT scene, point_idx, {s6(' + '.join(f'(feat[{i}] + f{i}) * {i}' for i in range(1, 9)))} AS feat_sum
FROM c JOIN p ON c.scene = p.scene AND c.gx // 2 = p.gx AND c.gy // 2 = p.gy AND c.gz // 2 = p.gz""".replace("SELECT scene, point_idx, floor", "SELECT c.scene AS scene, point_idx, floor"))
def grid_unpool(spark, sf):
    c = voxel.cells(points_emb_s(spark, sf), 0.05)
    return voxel.grid_unpool(c, voxel.grid_pool(c)).select("scene", "point_idx", r6(_weighted("feat")).alias("feat_sum"))


@query("mix_scenes", f"""
WITH {LI}, s AS (SELECT scene, max(instance) AS top, row_number() OVER (ORDER BY scene) - 1 AS rk FROM li GROUP BY scene),
p AS (SELECT a.scene, a.rk // 2 * 2 AS mix_id, CASE WHEN a.rk % 2 = 1 THEN greatest(b.top, -1) + 1 ELSE 0 END AS shift FROM s a JOIN s b ON b.rk = a.rk // 2 * 2)
SELECT scene, point_idx, mix_id, CASE WHEN instance >= 0 THEN instance + shift ELSE instance END AS instance FROM li JOIN p USING (scene)""")
def mix_scenes(spark, sf):
    return voxel.mix_scenes(points_li(spark, sf)).select("scene", "point_idx", "mix_id", "instance")


# Transforms


@query("norm_color", f"WITH {LI} " + _sel("li", r="r / 255.0", g="g / 255.0", b="b / 255.0"))
def norm_color(spark, sf):
    return _out(t.normalize_color(points_li(spark, sf)), *RGB)


@query("norm_coord", f"""
WITH {LI}, m AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM li WINDOW w AS (PARTITION BY scene)),
f AS (SELECT *, max(sqrt(dx * dx + dy * dy + dz * dz)) OVER (PARTITION BY scene) AS far FROM m) """ + _sel("f", x="dx / far", y="dy / far", z="dz / far"))
def norm_coord(spark, sf):
    return _out(t.normalize_coord(points_li(spark, sf)), *XYZ)


@query("positive_shift", f"WITH {LI} " + _sel("li", **{c: f"{c} - min({c}) OVER (PARTITION BY scene)" for c in XYZ}))
def positive_shift(spark, sf):
    return _out(t.positive_shift(points_li(spark, sf)), *XYZ)


_MID = "(min({0}) OVER (PARTITION BY scene) + max({0}) OVER (PARTITION BY scene)) / 2"


@query("center_shift", f"WITH {LI} " + _sel("li", x="x - " + _MID.format("x"), y="y - " + _MID.format("y"), z="z - min(z) OVER (PARTITION BY scene)"))
def center_shift(spark, sf):
    return _out(t.center_shift(points_li(spark, sf)), *XYZ)


@query("point_clip", f"WITH {LI} " + _sel("li", x="least(greatest(x, 5), 40)", y="least(greatest(y, 10), 50)", z="least(greatest(z, 1), 8)"))
def point_clip(spark, sf):
    return _out(t.point_clip(points_li(spark, sf), (5, 10, 1, 40, 50, 8)), *XYZ)


@query("auto_contrast", f"""
WITH {LI}, m AS (SELECT *, {', '.join(f'min({c}) OVER (PARTITION BY scene) AS lo_{c}, max({c}) OVER (PARTITION BY scene) AS hi_{c}' for c in RGB)} FROM li) """ + _sel("m", **{c: f"CASE WHEN hi_{c} = lo_{c} THEN {c} ELSE 0.5 * {c} + 0.5 * (({c} - lo_{c}) * (255.0 / (hi_{c} - lo_{c}))) END" for c in RGB}))
def auto_contrast(spark, sf):
    return _out(t.auto_contrast(points_li(spark, sf)), *RGB)


@query("auto_contrast_v2", f"""
WITH {LI}, m AS (SELECT *, {', '.join(f'min({c}) OVER (PARTITION BY scene) AS lo_{c}, max({c}) OVER (PARTITION BY scene) AS hi_{c}' for c in RGB)} FROM li) """ + _sel("m", **{c: f"0.5 * {c} + 0.5 * (({c} - lo_{c}) * (255.0 / (hi_{c} - lo_{c} + 1e-6)))" for c in RGB}))
def auto_contrast_v2(spark, sf):
    return _out(t.auto_contrast(points_li(spark, sf), eps=1e-6), *RGB)


@query("min_max", f"WITH {LI} " + _sel("li", **{c: f"coalesce(({c} - min({c}) OVER (PARTITION BY scene)) / nullif(max({c}) OVER (PARTITION BY scene) - min({c}) OVER (PARTITION BY scene), 0), 0)" for c in (*XYZ, "strength")}))
def min_max(spark, sf):
    return _out(t.min_max(points_li(spark, sf), (*XYZ, "strength")), *XYZ, "strength")


_GRAY = "(0.2989::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


@query("gray", f"WITH {LI} " + _sel("li", r=_GRAY, g=_GRAY, b=_GRAY))
def gray(spark, sf):
    return _out(t.color_gray_scale(points_li(spark, sf)), *RGB)


@query("contrast", f"WITH {LI}, m AS (SELECT *, avg({_GRAY}) OVER (PARTITION BY scene) AS mean FROM li) SELECT scene, point_idx, " + ", ".join(s6(f"least(greatest(1.3::DOUBLE * {c} + (1.0 - 1.3::DOUBLE) * mean, 0), 255)", 9) + f" AS {c}" for c in RGB) + " FROM m")
def contrast(spark, sf):
    return t.contrast(points_li(spark, sf), F.lit(1.3)).select("scene", "point_idx", *(r6(c, 9).alias(c) for c in RGB))


@query("saturation", f"WITH {LI} " + _sel("li", **{c: f"least(greatest(0.7::DOUBLE * {c} + (1.0 - 0.7::DOUBLE) * {_GRAY}, 0), 255)" for c in RGB}))
def saturation(spark, sf):
    return _out(t.saturation(points_li(spark, sf), F.lit(0.7)), *RGB)


@query("brightness", f"WITH {LI} " + _sel("li", **{c: f"least(greatest(1.2::DOUBLE * {c}, 0), 255)" for c in RGB}))
def brightness(spark, sf):
    return _out(t.brightness(points_li(spark, sf), F.lit(1.2)), *RGB)


_HSV = f"""WITH {LI}, a AS (SELECT scene, point_idx, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM li),
h0 AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END / 6 AS q, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s FROM a),
hsv AS (SELECT scene, point_idx, q - floor(q) AS h, s, hi AS v FROM h0)"""


def _rgb_sql(h: str, s: str, v: str, top: str = "{}") -> str:
    """Colours of hue, saturation and value by their triangle form: v (1 - s max(0, min(k, 4-k, 1))), k = (n + 6h) mod 6."""
    k = {c: f"(({n} + 6 * ({h})) - 6 * floor(({n} + 6 * ({h})) / 6))" for c, n in (("r", 5), ("g", 3), ("b", 1))}
    return ", ".join(f"{s6(top.format(f'{v} * (1 - ({s}) * greatest(0, least({k[c]}, 4 - {k[c]}, 1)))'), 9)} AS {c}" for c in RGB)


@query("hue_shift", f"{_HSV} SELECT scene, point_idx, {_rgb_sql('h + 0.07::DOUBLE', 's', 'v')} FROM hsv")
def hue_shift(spark, sf):
    return t.hue(points_li(spark, sf), F.lit(0.07)).select("scene", "point_idx", *(r6(c, 9).alias(c) for c in RGB))


@query("hue_saturation", f"{_HSV} SELECT scene, point_idx, {_rgb_sql('h - 0.11::DOUBLE', 'least(greatest(s * 1.15::DOUBLE, 0), 1)', 'v', 'least(greatest({}, 0), 255)')} FROM hsv")
def hue_saturation(spark, sf):
    return t.hue_saturation(points_li(spark, sf), F.lit(-0.11), F.lit(0.15)).select("scene", "point_idx", *(r6(c, 9).alias(c) for c in RGB))


@query("rotate_z", f"WITH {LI}, m AS (SELECT *, {_MID.format('x')} AS cx, {_MID.format('y')} AS cy FROM li) " + _sel("m", x="cos(0.3::DOUBLE) * (x - cx) - sin(0.3::DOUBLE) * (y - cy) + cx", y="sin(0.3::DOUBLE) * (x - cx) + cos(0.3::DOUBLE) * (y - cy) + cy", z="z", nx="cos(0.3::DOUBLE) * strength - sin(0.3::DOUBLE)", ny="sin(0.3::DOUBLE) * strength + cos(0.3::DOUBLE)", nz="0.5::DOUBLE"))
def rotate_z(spark, sf):
    p = points_li(spark, sf).withColumns({"nx": F.col("strength"), "ny": F.lit(1.0), "nz": F.lit(0.5)})
    return _out(t.rotate(p, 0.3), *XYZ, "nx", "ny", "nz")


def _turned(angle: str) -> dict[str, str]:
    return {"x": f"cos({angle}) * x - sin({angle}) * y", "y": f"sin({angle}) * x + cos({angle}) * y", "z": "z"}


@query("random_rotate", f"WITH {LI}, m AS (SELECT *, CASE WHEN {draw_sql('rotate/p', 'scene')} <= 0.5 THEN {uniform_sql('rotate', -1.0, 1.0, 'scene')} * pi() ELSE 0 END AS w FROM li) " + _sel("m", **_turned("w")))
def random_rotate(spark, sf):
    return _out(t.random_rotate(points_li(spark, sf), center=[F.lit(0.0)] * 3), *XYZ)


@query("random_rotate_target", f"WITH {LI}, m AS (SELECT *, CASE WHEN {draw_sql('turn/p', 'scene')} <= 0.75 THEN [0.5, 1.0, 1.5][CAST(floor({draw_sql('turn', 'scene')} * 3) AS INT) + 1]::DOUBLE * pi() ELSE 0 END AS w FROM li) " + _sel("m", **_turned("w")))
def random_rotate_target(spark, sf):
    return _out(t.random_rotate_target(points_li(spark, sf), center=[F.lit(0.0)] * 3), *XYZ)


@query("random_scale", f"WITH {LI} " + _sel("li", **{c: f"{c} * {uniform_sql('scale/' + c, 0.95, 1.05, 'scene')}" for c in XYZ}))
def random_scale(spark, sf):
    return _out(t.random_scale(points_li(spark, sf), anisotropic=True), *XYZ)


@query("random_flip", f"WITH {LI} " + _sel("li", x=f"x * CASE WHEN {draw_sql('flip/x', 'scene')} < 0.5 THEN -1 ELSE 1 END", y=f"y * CASE WHEN {draw_sql('flip/y', 'scene')} < 0.5 THEN -1 ELSE 1 END", z="z"))
def random_flip(spark, sf):
    return _out(t.random_flip(points_li(spark, sf)), *XYZ)


@query("random_shift", f"WITH {LI} " + _sel("li", x=f"x + {uniform_sql('shift/x', -0.2, 0.2, 'scene')}", y=f"y + {uniform_sql('shift/y', -0.2, 0.2, 'scene')}", z="z"))
def random_shift(spark, sf):
    return _out(t.random_shift(points_li(spark, sf)), *XYZ)


def _cut(e: str, lo: str, hi: str) -> str:
    return f"least(greatest({e}, {lo}::DOUBLE), {hi}::DOUBLE)"


@query("random_jitter", f"WITH {LI} " + _sel("li", **{c: f"{c} + " + _cut(f"0.01::DOUBLE * {normal_sql('jitter/' + c)}", "-0.05", "0.05") for c in XYZ}))
def random_jitter(spark, sf):
    return _out(t.random_jitter(points_li(spark, sf)), *XYZ)


@query("clip_gaussian_jitter", f"WITH {LI} " + _sel("li", **{f"jitter_{c}": "0.02::DOUBLE * " + _cut(f"{normal_sql('gauss/' + c)} / 1.96::DOUBLE", "-1.0", "1.0") for c in XYZ}))
def clip_gaussian_jitter(spark, sf):
    return _out(t.clip_gaussian_jitter(points_li(spark, sf), keep=True), *(f"jitter_{c}" for c in XYZ))


@query("chromatic_translation", f"WITH {LI} " + _sel("li", **{c: f"CASE WHEN {draw_sql('tint/p', 'scene')} < 0.95 THEN " + _cut(f"{c} + ({draw_sql('tint/' + c, 'scene')} - 0.5) * 25.5::DOUBLE", "0", "255") + f" ELSE {c} END" for c in RGB}))
def chromatic_translation(spark, sf):
    return _out(t.chromatic_translation(points_li(spark, sf)), *RGB)


@query("chromatic_jitter", f"WITH {LI} " + _sel("li", **{c: f"CASE WHEN {draw_sql('speckle/p', 'scene')} < 0.95 THEN " + _cut(f"{c} + {normal_sql('speckle/' + c)} * 0.005::DOUBLE * 255", "0", "255") + f" ELSE {c} END" for c in RGB}))
def chromatic_jitter(spark, sf):
    return _out(t.chromatic_jitter(points_li(spark, sf)), *RGB)


@query("color_drop", f"WITH {LI} " + _sel("li", **{c: f"CASE WHEN {draw_sql('drop', 'scene')} < 0.2 THEN 0 ELSE {c} END" for c in RGB}))
def color_drop(spark, sf):
    return _out(t.color_drop(points_li(spark, sf)), *RGB)


@query("color_jitter")
def color_jitter(spark, sf):
    return _out(t.color_jitter(points_li(spark, sf), order=5), *RGB)


@query("elastic_distortion", f"""
WITH {EMB_S}, lo AS (SELECT *, {', '.join(f'({c} - min({c}) OVER (PARTITION BY scene)) / 0.2::DOUBLE + 2.0 AS a{c}' for c in XYZ)} FROM emb),
k AS (SELECT scene, point_idx, {', '.join(f'CAST(floor(a{c}) AS BIGINT) + k{c}.v AS n{c}' for c in XYZ)}, {' * '.join(f'(CASE WHEN k{c}.v = 1 THEN a{c} - floor(a{c}) ELSE 1 - (a{c} - floor(a{c})) END)' for c in XYZ)} AS w
    FROM lo, {', '.join(f'(VALUES (0), (1)) k{c}(v)' for c in XYZ)}),
n AS (SELECT DISTINCT scene, nx, ny, nz FROM k),
s(d, w) AS (VALUES (-2, 1 / 9.0::DOUBLE), (-1, 2 / 9.0::DOUBLE), (0, 3 / 9.0::DOUBLE), (1, 2 / 9.0::DOUBLE), (2, 1 / 9.0::DOUBLE)),
e AS (SELECT scene, nx, ny, nz, {', '.join(f"sum(sx.w * sy.w * sz.w * {normal_sql('elastic/' + c, 'scene', 'nx + sx.d', 'ny + sy.d', 'nz + sz.d')}) AS v{c}" for c in XYZ)} FROM n, s sx, s sy, s sz GROUP BY ALL),
m AS (SELECT scene, point_idx, sum(w * vx) AS vx, sum(w * vy) AS vy, sum(w * vz) AS vz FROM k JOIN e USING (scene, nx, ny, nz) GROUP BY ALL)
SELECT scene, point_idx, {', '.join(f'{s6(f"{c} + 0.4::DOUBLE * v{c}")} AS {c}' for c in XYZ)} FROM emb JOIN m USING (scene, point_idx)""")
def elastic_distortion(spark, sf):
    return _out(t.elastic_distortion(points_emb_s(spark, sf)), *XYZ)


@query("pose_align", f"""
WITH {LI}, p AS (SELECT *, scene % 7 * 0.1::DOUBLE AS a, CAST(scene % 5 AS DOUBLE) AS tx, 0.2::DOUBLE AS ta FROM li),
w AS (SELECT scene, point_idx, cos(a) * x - sin(a) * y + tx AS wx, sin(a) * x + cos(a) * y - tx AS wy, z + 1 AS wz, ta FROM p)
SELECT scene, point_idx, {s6('cos(ta) * (wx - 3) + sin(ta) * (wy - 4)')} AS x, {s6('cos(ta) * (wy - 4) - sin(ta) * (wx - 3)')} AS y, {s6('wz - 5')} AS z FROM w""")
def pose_align(spark, sf):
    def pose(a, tx, ty, tz):
        z, o = F.lit(0.0), F.lit(1.0)
        return F.array(F.cos(a), -F.sin(a), z, tx, F.sin(a), F.cos(a), z, ty, z, z, o, tz, z, z, z, o)

    p = points_li(spark, sf)
    tx = (F.col("scene") % 5).cast("double")
    p = p.withColumns({"pose": pose(F.col("scene") % 7 * 0.1, tx, -tx, F.lit(1.0)), "target_pose": pose(F.lit(0.2), F.lit(3.0), F.lit(4.0), F.lit(5.0))})
    return _out(t.align_pose(p), *XYZ)


@query("unproject", f"WITH {LI} " + _sel("li", x="(x - 25) * y / 40 + 0.5", y="(z - 5) * y / 30 + 0.25", z="y"))
def unproject(spark, sf):
    p = points_li(spark, sf).select("scene", "point_idx", F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("depth"))
    return _out(t.unproject(p, 40.0, 30.0, 25.0, 5.0, 0.5, 0.25), *XYZ)


@query("unproject_fov", f"WITH {LI} " + _sel("li", x="(x - 25) * y / (25 / tan(0.6::DOUBLE))", y="(z - 6) * y / (6 / tan(0.4::DOUBLE))", z="y"))
def unproject_fov(spark, sf):
    p = points_li(spark, sf).select("scene", "point_idx", F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("depth"))
    return _out(t.unproject_fov(p, 50, 12, 0.6, 0.4), *XYZ)


_AZ, _EL = "((x + 0.5) / 51 * 2.0 * pi() - pi())", "(pi() / 2 - (z + 0.5) / 11 * pi())"


@query("unproject_panorama", f"WITH {LI} " + _sel("li", x=f"y * cos({_EL}) * sin({_AZ})", y=f"y * cos({_EL}) * cos({_AZ})", z=f"y * sin({_EL})"))
def unproject_panorama(spark, sf):
    p = points_li(spark, sf).select("scene", "point_idx", F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("depth"))
    return _out(t.unproject_panorama(p, 51, 11), *XYZ)


@query("camera_basis", f"""WITH {LI}, c AS (SELECT scene, point_idx, x AS vx, -y AS vy, z AS vz, r AS ux, -g AS uy, b AS uz FROM li)
SELECT scene, point_idx, {s6('vy * uz - vz * uy')} AS right_x, {s6('vz * ux - vx * uz')} AS right_y, {s6('vx * uy - vy * ux')} AS right_z, {s6('vx / 1000')} AS place_x, {s6('vy / 1000')} AS place_y, {s6('vz / 1000')} AS place_z FROM c""")
def camera_basis(spark, sf):
    p = points_li(spark, sf).select("scene", "point_idx", F.col("x").alias("tx"), F.col("z").alias("ty"), F.col("y").alias("tz"), F.col("r").alias("ux"), F.col("b").alias("uy"), F.col("g").alias("uz"), F.col("x").alias("px"), F.col("z").alias("py"), F.col("y").alias("pz"))
    return _out(t.camera_basis(p), "right_x", "right_y", "right_z", "place_x", "place_y", "place_z")


_STEP = "coalesce(lead({0}) OVER {1} - {0}, {0} - lag({0}) OVER {1}, 0)"


@query("grid_normals", f"""
WITH {LI}, i AS (SELECT *, point_idx // 16 AS v, point_idx % 16 AS u FROM li),
s AS (SELECT scene, point_idx, {', '.join(f"{_STEP.format(c, 'across')} AS a{c}, {_STEP.format(c, 'down')} AS d{c}" for c in XYZ)} FROM i WINDOW across AS (PARTITION BY scene, v ORDER BY u), down AS (PARTITION BY scene, u ORDER BY v)),
n AS (SELECT scene, point_idx, ay * dz - az * dy AS nx, az * dx - ax * dz AS ny, ax * dy - ay * dx AS nz FROM s),
l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM n) """ + _sel("l", **{c: f"{c} / CASE WHEN len > 0 THEN len ELSE 1 END" for c in ("nx", "ny", "nz")}))
def grid_normals(spark, sf):
    p = points_li(spark, sf).withColumns({"v": F.floor(F.col("point_idx") / 16), "u": F.col("point_idx") % 16})
    return _out(t.grid_normals(p), "nx", "ny", "nz")


@query("quaternion_yaw", f"WITH {EMB_S}, q AS (SELECT scene, point_idx, feat[1] AS w, feat[2] AS x, feat[3] AS y, feat[4] AS z, feat[1]*feat[1] + feat[2]*feat[2] + feat[3]*feat[3] + feat[4]*feat[4] AS n FROM emb) " + _sel("q", yaw="atan2(2.0 * (w * z + x * y) / n, 1.0 - 2.0 * (y * y + z * z) / n)"))
def quaternion_yaw(spark, sf):
    f = [F.element_at("feat", i) for i in range(1, 5)]
    n = F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2] + f[3] * f[3])
    p = points_emb_s(spark, sf).withColumn("n", n)
    return p.select("scene", "point_idx", r6(t.quaternion_yaw(*(c / F.col("n") for c in f))).alias("yaw"))


@query("boxes_to_sensor", f"""
WITH {LI}, e AS (SELECT *, cos(strength) * (x - 10) + sin(strength) * (y - 20) AS ex, cos(strength) * (y - 20) - sin(strength) * (x - 10) AS ey, z - 1 AS ez FROM li)
SELECT scene, point_idx, {s6('cos(0.5::DOUBLE) * (ex - 1) + sin(0.5::DOUBLE) * (ey - 0.5)')} AS x, {s6('cos(0.5::DOUBLE) * (ey - 0.5) - sin(0.5::DOUBLE) * (ex - 1)')} AS y, {s6('ez - 1.8')} AS z,
    {s6('r / 100 - (strength + 0.5)')} AS yaw, {s6('cos(strength + 0.5) * g + sin(strength + 0.5) * b')} AS vx, {s6('cos(strength + 0.5) * b - sin(strength + 0.5) * g')} AS vy FROM e""")
def boxes_to_sensor(spark, sf):
    fixed = {"ex": 10.0, "ey": 20.0, "ez": 1.0, "sx": 1.0, "sy": 0.5, "sz": 1.8, "syaw": 0.5}
    p = points_li(spark, sf).withColumns({k: F.lit(v) for k, v in fixed.items()} | {"eyaw": F.col("strength"), "yaw": F.col("r") / 100, "vx": F.col("g"), "vy": F.col("b")})
    return _out(t.boxes_to_sensor(p), *XYZ, "yaw", "vx", "vy")


@query("squash_and_shift", f"WITH {LI} " + _sel("li", keep="segment - 1 AS segment, ", strength="tanh(strength)"))
def squash_and_shift(spark, sf):
    return _out(t.shift_labels(t.squash(points_li(spark, sf))), "strength", keep=("segment",))


LEARNING = {0: 9, 1: 8, 2: 7, 3: 6, 4: 5}


@query("label_remap", f"WITH {LI} SELECT scene, point_idx, CASE segment WHEN 0 THEN 9 WHEN 1 THEN 8 WHEN 2 THEN 7 WHEN 3 THEN 6 WHEN 4 THEN 5 ELSE -1 END AS segment FROM li")
def label_remap(spark, sf):
    return t.remap(points_li(spark, sf), "segment", LEARNING).select("scene", "point_idx", F.col("segment").cast("int").alias("segment"))


@query("collect_features", f"WITH {LI} SELECT scene, point_idx, segment, {s6('x + 2 * y + 3 * z + 4 * r + 5 * g + 6 * b')} AS feat_sum FROM li")
def collect_features(spark, sf):
    c = t.collect_keys(points_li(spark, sf), ["segment"], feat=[*XYZ, *RGB])
    return c.select("scene", "point_idx", "segment", r6(_weighted("feat")).alias("feat_sum"))


@query("scene_offsets", f"WITH {LI}, n AS (SELECT scene, count(*) AS n FROM li GROUP BY scene) SELECT scene, n, CAST(sum(n) OVER (ORDER BY scene) AS BIGINT) AS \"offset\" FROM n")
def scene_offsets(spark, sf):
    return t.offsets(points_li(spark, sf))


@query("gaussian_kernel", f"WITH {LI} " + _sel("li", w="2.0 * exp(-(x * x + z * z) / (2.0 * 30 * 30))"))
def gaussian_kernel(spark, sf):
    return points_li(spark, sf).select("scene", "point_idx", r6(t.gaussian_kernel(F.col("x") * F.col("x") + F.col("z") * F.col("z"), 2.0, 30.0)).alias("w"))


# Crops and views


@query("crop_boundary", f"WITH {LI} SELECT scene, point_idx, segment FROM li WHERE segment NOT IN (0, 1)")
def crop_boundary(spark, sf):
    return crops.crop_boundary(points_li(spark, sf)).select("scene", "point_idx", "segment")


_CENTER = """n AS (SELECT *, count(*) OVER (PARTITION BY scene) AS n FROM li), c AS (SELECT scene, x AS cx, y AS cy, z AS cz, n FROM n WHERE point_idx = n // 2)"""
_D2 = "((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))"


@query("sphere_crop", f"WITH {LI}, {_CENTER}, k AS (SELECT li.scene, point_idx, row_number() OVER (PARTITION BY li.scene ORDER BY {_D2}, point_idx) AS rk FROM li JOIN c ON c.scene = li.scene) SELECT scene, point_idx FROM k WHERE rk <= 200")
def sphere_crop(spark, sf):
    return crops.sphere_crop(points_li(spark, sf), 200).select("scene", "point_idx")


_MIDDLE = ", ".join(f"max(CASE WHEN point_idx = n // 2 THEN {c} END) OVER (PARTITION BY scene) AS c{c}" for c in XYZ)


@query("cylinder_crop", f"""WITH {LI}, n AS MATERIALIZED (SELECT scene, point_idx, x, y, z, count(*) OVER (PARTITION BY scene) AS n FROM li), c AS MATERIALIZED (SELECT *, {_MIDDLE} FROM n)
SELECT scene, point_idx FROM c WHERE n <= 100 OR {_D2} < 225""")
def cylinder_crop(spark, sf):
    return crops.cylinder_crop(points_li(spark, sf), 100, 15.0).select("scene", "point_idx")


@query("dropout", f"""
WITH {LI}, k AS (SELECT scene, point_idx, segment, row_number() OVER (PARTITION BY scene ORDER BY {draw_sql('dropout')}, point_idx) AS rk, count(*) OVER (PARTITION BY scene) AS n FROM li)
SELECT scene, point_idx FROM k WHERE {draw_sql('dropout/scene', 'scene')} >= 0.5 OR rk <= floor(n * (1 - 0.2::DOUBLE)) OR segment = 0""")
def dropout(spark, sf):
    return t.random_dropout(points_li(spark, sf).withColumn("labeled", F.col("segment") == 0), labeled="labeled").select("scene", "point_idx")


@query("shuffle", f"WITH {LI} SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY {draw_sql('shuffle')}, point_idx) - 1 AS point_idx, point_idx AS old_idx FROM li")
def shuffle(spark, sf):
    return t.shuffle(points_li(spark, sf)).select("scene", "point_idx", "old_idx")


@query("split_assign", f"WITH {LI} SELECT DISTINCT scene, CASE WHEN scene < 70 THEN 'train' WHEN scene < 85 THEN 'val' ELSE 'test' END AS split FROM li")
def split_assign(spark, sf):
    return crops.split_by_range(points_li(spark, sf).select("scene").distinct(), "scene", 70, 85)


def _major(points: str = "emb") -> str:
    return f"""b AS (SELECT scene, arg_min([x, y, z], {draw_sql('{}/major')}) AS c FROM {points} GROUP BY scene), nn AS (SELECT scene, count(*) AS n FROM {points} GROUP BY scene),
mr AS (SELECT p.scene, point_idx, x, y, z, n, row_number() OVER (PARTITION BY p.scene ORDER BY (x - c[1]) * (x - c[1]) + (y - c[2]) * (y - c[2]) + (z - c[3]) * (z - c[3]), point_idx) AS rk FROM {points} p JOIN b ON b.scene = p.scene JOIN nn ON nn.scene = p.scene)"""


@query("major_view", f"""WITH {EMB_S}, {_major().format('views')}
SELECT scene, point_idx, rk AS rank FROM mr WHERE rk <= floor({uniform_sql('views/major/size', 0.4, 1.0, 'scene')} * least(65536, n))""")
def major_view(spark, sf):
    v = crops.multi_view(points_emb_s(spark, sf), n_global=1, n_local=0)
    return v.select("scene", "point_idx", F.col("rank").cast("long").alias("rank"))


_BLOCK = f"""WITH {EMB_S}, {_major().format('blocks')}, v AS (SELECT scene, point_idx, x, y, z, n FROM mr WHERE rk <= floor({uniform_sql('blocks/size', 0.6, 1.0, 'scene')} * least(65536, n))),
q0 AS (SELECT scene, arg_min([x, y, z], {draw_sql('blocks/0')}) AS c FROM v GROUP BY scene),
t0 AS (SELECT * FROM (SELECT v.scene, point_idx, n, row_number() OVER (PARTITION BY v.scene ORDER BY (x - c[1]) * (x - c[1]) + (y - c[2]) * (y - c[2]) + (z - c[3]) * (z - c[3]), point_idx) AS rk FROM v JOIN q0 ON q0.scene = v.scene) WHERE rk <= floor({uniform_sql('blocks/0/size', 0.05, 0.15, 'scene')} * least(65536, n))),
f1 AS (SELECT * FROM v ANTI JOIN t0 USING (scene, point_idx)), q1 AS (SELECT scene, arg_min([x, y, z], {draw_sql('blocks/1')}) AS c FROM f1 GROUP BY scene),
t1 AS (SELECT * FROM (SELECT f1.scene, point_idx, n, row_number() OVER (PARTITION BY f1.scene ORDER BY (x - c[1]) * (x - c[1]) + (y - c[2]) * (y - c[2]) + (z - c[3]) * (z - c[3]), point_idx) AS rk FROM f1 JOIN q1 ON q1.scene = f1.scene) WHERE rk <= floor({uniform_sql('blocks/1/size', 0.05, 0.15, 'scene')} * least(65536, n)))"""


@query("context_view", f"""{_BLOCK} SELECT scene, point_idx, 0 AS block, 1 AS is_target FROM t0 UNION ALL SELECT scene, point_idx, 1, 1 FROM t1
UNION ALL SELECT scene, point_idx, NULL, 0 FROM f1 ANTI JOIN t1 USING (scene, point_idx)""")
def context_view(spark, sf):
    return crops.multi_block(points_emb_s(spark, sf), 2, overlap=False).select("scene", "point_idx", "block", "is_target")


@query("multi_view")
def multi_view(spark, sf):
    return crops.multi_view(points_emb_s(spark, sf), 2, 3).select("scene", "point_idx", "kind", "view")


_FUSED = _BLOCK.replace("FROM f1 JOIN q1 ON q1.scene = f1.scene", "FROM v f1 JOIN q1 ON q1.scene = f1.scene")


@query("early_fuse_blocks", f"""{_FUSED} SELECT scene, point_idx, 0 AS block, 1 AS is_target FROM t0 UNION ALL SELECT scene, point_idx, 1, 1 FROM t1
UNION ALL SELECT scene, point_idx, k, 0 FROM v ANTI JOIN (SELECT scene, point_idx FROM t0 UNION SELECT scene, point_idx FROM t1) t USING (scene, point_idx), (VALUES (0), (1)) b(k)""")
def early_fuse_blocks(spark, sf):
    return crops.multi_block(points_emb_s(spark, sf), 2, early_fuse=True).select("scene", "point_idx", "block", "is_target")


def _copy_sql(name: str) -> str:
    """The columns of one copy, from its own draws."""
    keys = ("scene", "block", f"'{name}'")
    turn, scale, flip = f"({uniform_sql('augment/turn', -1.0, 1.0, *keys)} * pi())", uniform_sql("augment/scale", 0.9, 1.1, *keys), f"({draw_sql('augment/flip', *keys)} < 0.5)"
    noise = {c: f"least(greatest({normal_sql(f'augment/{name}/{c}', 'scene', 'block', 'point_idx')} * 0.005::DOUBLE, -0.02::DOUBLE), 0.02::DOUBLE)" for c in XYZ}
    x, y, z = f"(CASE WHEN {flip} THEN -(x - mx / 2) ELSE x - mx / 2 END)", "(y - my / 2)", "(z - mz / 2)"
    turned = {"x": f"(cos({turn}) * {x} - sin({turn}) * {y})", "y": f"(sin({turn}) * {x} + cos({turn}) * {y})", "z": z}
    return ", ".join(f"{s6(f'{turned[c]} * {scale} + m{c} / 2 + {noise[c]}')} AS {name}_{c}" for c in XYZ)


@query("diff_aug_blocks", f"""{_FUSED}, fused AS (SELECT scene, point_idx, 0 AS block, 1 AS is_target FROM t0 UNION ALL SELECT scene, point_idx, 1, 1 FROM t1
UNION ALL SELECT scene, point_idx, k, 0 FROM v ANTI JOIN (SELECT scene, point_idx FROM t0 UNION SELECT scene, point_idx FROM t1) t USING (scene, point_idx), (VALUES (0), (1)) b(k)),
fp AS (SELECT fused.*, x, y, z FROM fused JOIN emb USING (scene, point_idx)), mid AS (SELECT scene, block, min(x) + max(x) AS mx, min(y) + max(y) AS my, min(z) + max(z) AS mz FROM fp GROUP BY scene, block)
SELECT scene, point_idx, block, is_target, {_copy_sql('student')}, {_copy_sql('teacher')} FROM fp JOIN mid USING (scene, block)""")
def diff_aug_blocks(spark, sf):
    """Each target of a scene with its context, changed by draws of its own, once for the student and once for the teacher."""
    b = crops.multi_block(points_emb_s(spark, sf), 2, early_fuse=True).select("scene", "point_idx", "block", "is_target", *XYZ)
    out = crops.augmented_blocks(b, crops.drawn_augments(b))
    return out.select("scene", "point_idx", "block", "is_target", *(r6(F.col(n)[i]).alias(f"{n}_{c}") for n in ("student", "teacher") for i, c in enumerate(XYZ)))


@query("contrastive_views", f"WITH {LI} SELECT scene, point_idx, k AS view, {s6('x + ' + '(CASE k WHEN 1 THEN ' + uniform_sql('view1/x', -0.2, 0.2, 'scene') + ' ELSE ' + uniform_sql('view2/x', -0.2, 0.2, 'scene') + ' END)')} AS x FROM li, (VALUES (1), (2)) v(k)")
def contrastive_views(spark, sf):
    v = crops.two_views(points_li(spark, sf), transform=lambda d, s: t.random_shift(d, salt=s))
    return v.select("scene", "point_idx", "view", r6("x").alias("x"))


# Curves

_CODE = " | ".join(f"((({c} >> {i}) & 1) << {3 * i + s})" for i in range(8) for c, s in (("gx", 2), ("gy", 1), ("gz", 0)))


@query("morton", f"WITH {LI}, {_cells(0.5, 'li')} SELECT scene, point_idx, {_CODE} AS code FROM c")
def morton(spark, sf):
    return curve.encode(voxel.cells(points_li(spark, sf), 0.5)).select("scene", "point_idx", "code")


@query("morton_decode", f"WITH {LI}, {_cells(0.5, 'li')} SELECT scene, point_idx, gx, gy, gz FROM c")
def morton_decode(spark, sf):
    c = curve.encode(voxel.cells(points_li(spark, sf), 0.5)).drop("gx", "gy", "gz")
    return curve.decode(c).select("scene", "point_idx", "gx", "gy", "gz")


_RANK = f"k AS (SELECT scene, point_idx, row_number() OVER (PARTITION BY scene ORDER BY {_CODE}, point_idx) - 1 AS rk, count(*) OVER (PARTITION BY scene) AS n FROM c)"


@query("morton_rank", f"WITH {LI}, {_cells(0.5, 'li')}, {_RANK} SELECT scene, point_idx, rk AS rank_0 FROM k")
def morton_rank(spark, sf):
    return curve.serialize(voxel.cells(points_li(spark, sf), 0.5)).select("scene", "point_idx", "rank_0")


@query("patches", f"""
WITH {LI}, {_cells(0.5, 'li')}, {_RANK}
SELECT scene, point_idx, rk // 64 AS patch, rk % 64 AS slot, false AS borrowed FROM k
UNION ALL SELECT scene, point_idx, (rk + 64) // 64, (rk + 64) % 64, true FROM k WHERE n > 64 AND n % 64 <> 0 AND rk + 64 >= n AND rk + 64 < (n + 63) // 64 * 64""")
def patches(spark, sf):
    return curve.patches(curve.serialize(voxel.cells(points_li(spark, sf), 0.5)), 64)


_XY = "CASE WHEN a{i} & q <> 0 THEN xor({x}, q - 1) ELSE xor({x}, xor({x}, a{i}) & (q - 1)) END"
_TURN = f"""SELECT scene, point_idx, q // 2 AS q, {_XY.format(i=2, x='b0')} AS a0, b1 AS a1, CASE WHEN a2 & q <> 0 THEN a2 ELSE xor(a2, xor(b0, a2) & (q - 1)) END AS a2
    FROM (SELECT *, CASE WHEN a1 & q <> 0 THEN a1 ELSE xor(a1, xor(z0, a1) & (q - 1)) END AS b1, {_XY.format(i=1, x='z0')} AS b0
        FROM (SELECT *, CASE WHEN a0 & q <> 0 THEN xor(a0, q - 1) ELSE a0 END AS z0 FROM t WHERE q > 1))"""
_HILBERT = f"""WITH RECURSIVE {LI}, {_cells(0.5, 'li')},
t AS (SELECT scene, point_idx, CAST(32768 AS BIGINT) AS q, gx AS a0, gy AS a1, gz AS a2 FROM c UNION ALL {_TURN}),
g AS (SELECT scene, point_idx, a0, xor(a1, a0) AS a1, xor(a2, xor(a1, a0)) AS a2 FROM t WHERE q = 1),
f AS (SELECT *, list_reduce(list_transform(range(0, 16), lambda b: CASE WHEN a2 >> b & 1 = 1 THEN (1::BIGINT << b) - 1 ELSE 0::BIGINT END), lambda u, v: xor(u, v)) AS w FROM g)
SELECT scene, point_idx, CAST(list_sum(list_transform(range(0, 16), lambda b: ((xor(a0, w) >> b & 1) << (3 * b + 2)) + ((xor(a1, w) >> b & 1) << (3 * b + 1)) + ((xor(a2, w) >> b & 1) << (3 * b)))) AS BIGINT) AS code FROM f"""


@query("hilbert", _HILBERT)
def hilbert(spark, sf):
    return curve.encode(voxel.cells(points_li(spark, sf), 0.5), "hilbert").select("scene", "point_idx", "code")


@query("curve_depth", f"WITH {LI}, {_cells(0.5, 'li')} SELECT scene, CAST(length(bin(greatest(max(gx), max(gy), max(gz)) + 1)) AS INT) AS depth FROM c GROUP BY scene")
def curve_depth(spark, sf):
    return curve.depth_of(voxel.cells(points_li(spark, sf), 0.5))


@query("fan_back", f"""WITH {LI}, {_cells(2.0, 'li')}, v AS (SELECT scene, gx, gy, gz, min(point_idx) AS pred FROM c GROUP BY ALL) SELECT c.scene AS scene, point_idx, pred FROM c JOIN v USING (scene, gx, gy, gz)""".replace("c.scene AS scene", "scene"))
def fan_back(spark, sf):
    p = points_li(spark, sf)
    parts = tasks_li(spark, sf)
    inv = voxel.inverse(p, 2.0, parts)
    inv = inv.repartition(parts, "scene", "voxel_id") if parts > 1 else inv
    return voxel.fan_back(inv.groupBy("scene", "voxel_id").agg(F.min("point_idx").alias("pred")), inv)


@query("gray_codes", f"WITH {LI} SELECT scene, point_idx, xor(part, part >> 1) AS gray, part AS back FROM li")
def gray_codes(spark, sf):
    g = to_gray(F.col("part"))
    return points_li(spark, sf).select("scene", "point_idx", g.alias("gray"), from_gray(g).alias("back"))


@query("batched_code", f"WITH {LI}, {_cells(0.5, 'li')} SELECT scene, point_idx, (scene << 24) | {_CODE} AS code FROM c")
def batched_code(spark, sf):
    c = curve.encode(voxel.cells(points_li(spark, sf), 0.5))
    return c.select("scene", "point_idx", curve.batched(F.col("code"), F.col("scene"), 8).alias("code"))


@query("boxes_by_quaternion", f"""WITH {LI}, w AS (SELECT scene, point_idx, cos(strength) * (x - 1) + sin(strength) * (y - 2) AS ex, cos(strength) * (y - 2) - sin(strength) * (x - 1) AS ey, z - 3 AS ez, cos(strength) * g + sin(strength) * b AS vx, cos(strength) * b - sin(strength) * g AS vy, r, strength FROM li)
SELECT scene, point_idx, {s6('ex - 0.5')} AS x, {s6('0.6::DOUBLE * (ey - 0.25) + 0.8::DOUBLE * ez')} AS y, {s6('0.6::DOUBLE * ez - 0.8::DOUBLE * (ey - 0.25)')} AS z, {s6('vx')} AS vx, {s6('0.6::DOUBLE * vy')} AS vy,
    {s6('sqrt(0.8::DOUBLE) * cos(r / 200 - strength / 2)')} AS qw FROM w""")
def boxes_by_quaternion(spark, sf):
    c, s, half = F.col, F.lit(0.0), F.col("strength") / 2
    # The sensor turns about x by the angle whose cosine is 0.6 and sine 0.8.
    p = points_li(spark, sf).select("scene", "point_idx", F.array("x", "y", "z").alias("t"), F.array("g", "b", s).alias("v"), F.array(F.cos(c("r") / 200), s, s, F.sin(c("r") / 200)).alias("q"),
        F.array(*(F.lit(v) for v in (1.0, 2.0, 3.0))).alias("ego_t"), F.array(F.cos(half), s, s, F.sin(half)).alias("ego_q"), F.array(*(F.lit(v) for v in (0.5, 0.25, 0.0))).alias("sensor_t"), F.array(F.lit(0.8**0.5), F.lit(0.2**0.5), s, s).alias("sensor_q"))
    b = t.boxes_by_quaternion(p)
    at = lambda n, i: r6(c(n)[i])
    return b.select("scene", "point_idx", at("t", 0).alias("x"), at("t", 1).alias("y"), at("t", 2).alias("z"), at("v", 0).alias("vx"), at("v", 1).alias("vy"), at("q", 0).alias("qw"))
