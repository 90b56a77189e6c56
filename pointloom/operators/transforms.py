"""Per-point and scene-relative transforms, fixed and random (by hashed draws)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, clamp, col, draw, hsv_to_rgb, lookup, normal, quaternion_inverse, quaternion_product, quaternion_rotate, rgb_to_hsv, uniform

XYZ, RGB, NORMAL = ("x", "y", "z"), ("r", "g", "b"), ("nx", "ny", "nz")


# Rows and columns


def select_rows(df: DataFrame, rows: DataFrame, keep: bool = True) -> DataFrame:
    """The points whose keys are in ``rows``; those that are not, with ``keep=False``."""
    return df.join(rows.select(*KEY), KEY, "left_semi" if keep else "left_anti")


def collect_keys(df: DataFrame, keys: Sequence[str], **features: Sequence[str]) -> DataFrame:
    """The chosen columns; each group of ``features`` becomes one array of doubles."""
    groups = [F.array(*(F.col(c).cast("double") for c in cs)).alias(name) for name, cs in features.items()]
    return df.select(*KEY, *(k for k in keys if k not in KEY), *groups)


def offsets(df: DataFrame) -> DataFrame:
    """Row counts per scene and their running sum in scene order."""
    from .scan import prefix

    counts = df.groupBy("scene").agg(F.count("*").alias("n"))
    return prefix(counts, "scene", value="n", running="offset").drop("rank")


def off_diagonal(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    return df.where(F.col(i) != F.col(j))


def copy_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumns({new: F.col(old) for old, new in names.items()})


def update(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def to_tensor(df: DataFrame) -> DataFrame:
    """Integers as 64 bits, other numbers as 32-bit floats, booleans and the rest as they are."""
    to = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "double": "float"}
    return df.select(*(F.col(f"`{c}`").cast(to.get(t, t)).alias(c) for c, t in df.dtypes))


# Fixed transforms of single points


def normalize_color(df: DataFrame, columns=RGB) -> DataFrame:
    return df.withColumns({c: F.col(c) / 255.0 for c in columns})


def point_clip(df: DataFrame, box=(-80, -80, -3, 80, 80, 1)) -> DataFrame:
    """Coordinates moved to the nearest place in the box; no row is dropped."""
    return df.withColumns({c: clamp(F.col(c), float(box[i]), float(box[i + 3])) for i, c in enumerate(XYZ)})


def remap(df: DataFrame, column: str, table: dict[int, int], default: int = -1) -> DataFrame:
    return df.withColumn(column, lookup(F.col(column).cast("long"), {int(k): int(v) for k, v in table.items()}, default))


def shift_labels(df: DataFrame, column: str = "segment") -> DataFrame:
    return df.withColumn(column, F.col(column) - 1)


def squash(df: DataFrame, column: str = "strength") -> DataFrame:
    return df.withColumn(column, F.tanh(column))


def apply_matrix(x: Column, y: Column, z: Column, m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """A 4x4 matrix (16 columns, row by row) times homogeneous points."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def rigid_inverse(m: Sequence[Column]) -> list[Column]:
    """The inverse of a rotation and a shift."""
    r = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    t = [m[4 * i + 3] for i in range(3)]
    rows = []
    for j in range(3):
        rows += [r[0][j], r[1][j], r[2][j], -(r[0][j] * t[0] + r[1][j] * t[1] + r[2][j] * t[2])]
    return rows + [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def align_pose(df: DataFrame, pose: str = "pose", target: str = "target_pose") -> DataFrame:
    """Points of a frame in the coordinates of the target frame: inverse(target) x pose x point; poses are arrays of 16."""
    at = lambda name: [F.col(name)[i] for i in range(16)]
    world = apply_matrix(*(F.col(c) for c in XYZ), at(pose))
    return df.withColumns(dict(zip(XYZ, apply_matrix(*world, rigid_inverse(at(target))))))


def unproject(df: DataFrame, fx: float, fy: float, cx: float, cy: float, bx: float = 0.0, by: float = 0.0) -> DataFrame:
    """Pixels (u, v, depth) to points by pinhole intrinsics."""
    u, v, d = F.col("u"), F.col("v"), F.col("depth")
    return df.withColumns({"x": (u - cx) * d / fx + bx, "y": (v - cy) * d / fy + by, "z": d})


def unproject_fov(df: DataFrame, width: int, height: int, half_fov_x: float, half_fov_y: float) -> DataFrame:
    """As :func:`unproject`, with intrinsics from half angles of view."""
    return unproject(df, width / 2 / math.tan(half_fov_x), height / 2 / math.tan(half_fov_y), width / 2, height / 2)


def unproject_panorama(df: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of an equirectangular image to points on their spheres."""
    az = (F.col("u") + 0.5) / width * 2.0 * math.pi - math.pi
    el = math.pi / 2 - (F.col("v") + 0.5) / height * math.pi
    d = F.col("depth")
    return df.withColumns({"x": d * F.cos(el) * F.sin(az), "y": d * F.cos(el) * F.cos(az), "z": d * F.sin(el)})


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def camera_basis(df: DataFrame) -> DataFrame:
    """Right, up and forward of a camera in metres with z up, from its place (mm), view (tx, ty, tz) and up (ux, uy, uz).

    y and z change places between the two systems, and y its sign.
    """
    turn = lambda p: (F.col(p + "x"), -F.col(p + "z"), F.col(p + "y"))
    view, up = turn("t"), turn("u")
    right = cross(view, up)
    place = [c / 1000.0 for c in turn("p")]
    out = {f"{n}{a}": c for n, cs in (("right_", right), ("up_", up), ("view_", view), ("place_", place)) for a, c in zip("xyz", cs)}
    return df.withColumns(out)


def grid_normals(df: DataFrame, row: str = "v", column: str = "u") -> DataFrame:
    """Normals of an image of points: cross product of the steps to the right and down neighbours.

    At the last column and row the step from the one before stands in; zero vectors stay zero.
    """
    across, down = Window.partitionBy("scene", row).orderBy(column), Window.partitionBy("scene", column).orderBy(row)

    def step(c: str, w) -> Column:
        return F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w), F.lit(0.0))

    steps = df.withColumns({f"_a{c}": step(c, across) for c in XYZ}).withColumns({f"_d{c}": step(c, down) for c in XYZ})
    n = cross([F.col(f"_a{c}") for c in XYZ], [F.col(f"_d{c}") for c in XYZ])
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    return steps.withColumns({k: c / safe for k, c in zip(NORMAL, n)}).drop(*(f"_{s}{c}" for s in "ad" for c in XYZ))


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def boxes_to_sensor(df: DataFrame) -> DataFrame:
    """World boxes (x, y, z, vx, vy, yaw) in a sensor's frame by the ego (ex, ey, ez, eyaw) and sensor (sx, sy, sz, syaw) poses.

    Poses here turn about z, as the ego and top sensor do; sizes w, l, h come back as l, w, h.
    """

    def into(x, y, z, px, py, pz, yaw):
        dx, dy = x - px, y - py
        return F.cos(yaw) * dx + F.sin(yaw) * dy, F.cos(yaw) * dy - F.sin(yaw) * dx, z - pz

    c = F.col
    ego = into(c("x"), c("y"), c("z"), c("ex"), c("ey"), c("ez"), c("eyaw"))
    out = into(*ego, c("sx"), c("sy"), c("sz"), c("syaw"))
    turn = c("eyaw") + c("syaw")
    v = into(c("vx"), c("vy"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), turn)
    return df.withColumns({"x": out[0], "y": out[1], "z": out[2], "yaw": c("yaw") - turn, "vx": v[0], "vy": v[1]})


def boxes_by_quaternion(df: DataFrame, frames=("ego", "sensor")) -> DataFrame:
    """World boxes (t: x y z, q: w x y z, v: x y z, as arrays) moved into one frame after another, each given by ``<frame>_t`` and ``<frame>_q``."""
    t, v = [F.col("t")[i] for i in range(3)], [F.col("v")[i] for i in range(3)]
    q = [F.col("q")[i] for i in range(4)]
    for f in frames:
        back = quaternion_inverse([F.col(f"{f}_q")[i] for i in range(4)])
        t = quaternion_rotate(back, [t[i] - F.col(f"{f}_t")[i] for i in range(3)])
        v, q = quaternion_rotate(back, v), quaternion_product(back, q)
    return df.withColumns({"t": F.array(*t), "q": F.array(*q), "v": F.array(*v)})


def range_image_points(df: DataFrame, ranges: str = "ranges") -> DataFrame:
    """Pixels with a range above 0 of images told as (scene, laser, return_no, ranges, xs, ys, zs[, labels]) rows, as points.

    Points are numbered by return, laser and pixel; images without labels give 0.
    """
    arrays = F.arrays_zip(F.col(ranges).alias("range"), F.col("xs").alias("x"), F.col("ys").alias("y"), F.col("zs").alias("z"), (F.col("labels") if "labels" in df.columns else F.transform(ranges, lambda _: F.lit(0))).alias("segment"))
    p = df.select("scene", "laser", "return_no", F.posexplode(arrays).alias("pixel", "p")).select("scene", "laser", "return_no", "pixel", "p.*").where("range > 0")
    w = Window.partitionBy("scene").orderBy("return_no", "laser", "pixel")
    return p.withColumns({"segment": F.coalesce("segment", F.lit(0)), "point_idx": (F.row_number().over(w) - 1).cast("long")})


def attach_by_position(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """A column from a table of (scene, position, value): row n of an external label file belongs to point n."""
    v = values.select("scene", F.col("position").alias("point_idx"), F.col("value").alias(column))
    return df.join(v, KEY, "left")


def lwh(df: DataFrame) -> DataFrame:
    """Sizes given as width, length, height in the order length, width, height."""
    return df.withColumn("size", F.array("l", "w", "h"))


def gaussian_kernel(d2: Column, a: float, c: float) -> Column:
    return a * F.exp(-d2 / (2.0 * c * c))


# Scene-relative transforms: one aggregate row per scene joins its points


def with_scene(df: DataFrame, by: Sequence[str] = ("scene",), **aggregates: Column) -> DataFrame:
    """Points with aggregates of their scene.  The aggregates have a row per scene, so points are shuffled only if those are many."""
    return df.join(df.groupBy(*by).agg(*(c.alias(n) for n, c in aggregates.items())), list(by))


def normalize_coord(df: DataFrame) -> DataFrame:
    """Centred at the scene's mean, with the farthest point at distance 1."""
    c = with_scene(df, **{f"_m{k}": F.avg(k) for k in XYZ})
    c = c.withColumns({k: F.col(k) - F.col(f"_m{k}") for k in XYZ}).drop(*(f"_m{k}" for k in XYZ))
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return with_scene(c, _far=F.max(n)).withColumns({k: F.try_divide(k, "_far") for k in XYZ}).drop("_far")


def positive_shift(df: DataFrame) -> DataFrame:
    return with_scene(df, **{f"_l{k}": F.min(k) for k in XYZ}).withColumns({k: F.col(k) - F.col(f"_l{k}") for k in XYZ}).drop(*(f"_l{k}" for k in XYZ))


def center_shift(df: DataFrame, apply_z: bool = True) -> DataFrame:
    """The middle of the bounding box to 0 in x and y, its least z to 0."""
    c = with_scene(df, _cx=(F.min("x") + F.max("x")) / 2, _cy=(F.min("y") + F.max("y")) / 2, _cz=F.min("z") if apply_z else F.lit(0.0))
    return c.withColumns({k: F.col(k) - F.col(f"_c{k}") for k in XYZ}).drop("_cx", "_cy", "_cz")


def auto_contrast(df: DataFrame, blend: float = 0.5, eps: float = 0.0) -> DataFrame:
    """Colours stretched to 0..255 by the scene's range and blended in.  A colour of one value stays as it is where ``eps`` is 0."""
    c = with_scene(df, **{f"_l{k}": F.min(k) for k in RGB}, **{f"_h{k}": F.max(k) for k in RGB})

    def stretched(k: str) -> Column:
        full = (F.col(k) - F.col(f"_l{k}")) * F.try_divide(F.lit(255.0), F.col(f"_h{k}") - F.col(f"_l{k}") + eps)
        return F.coalesce((1 - blend) * F.col(k) + blend * full, F.col(k))

    return c.withColumns({k: stretched(k) for k in RGB}).drop(*(f"_{s}{k}" for s in "lh" for k in RGB))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column to 0..1 by its scene's range; 0 where that is empty or not a number."""
    c = with_scene(df, **{f"_l{k}": F.min(k) for k in columns}, **{f"_h{k}": F.max(k) for k in columns})
    scaled = lambda k: F.coalesce(F.nanvl(F.try_divide(F.col(k) - F.col(f"_l{k}"), F.col(f"_h{k}") - F.col(f"_l{k}")), F.lit(None)), F.lit(0.0))
    return c.withColumns({k: scaled(k) for k in columns}).drop(*(f"_{s}{k}" for s in "lh" for k in columns))


# Random transforms: draws by scene or by point


def random_shift(df: DataFrame, shift=((-0.2, 0.2), (-0.2, 0.2), (0.0, 0.0)), salt: str = "shift") -> DataFrame:
    return df.withColumns({c: F.col(c) + uniform(f"{salt}/{c}", *shift[i], "scene") for i, c in enumerate(XYZ)})


def random_dropout(df: DataFrame, ratio: float = 0.2, apply: float = 0.5, labeled: str | None = None, salt: str = "dropout", most: int | None = None) -> DataFrame:
    """Of scenes that are drawn, the ``int(n (1 - ratio))`` points with the least draws, and labelled points in any case."""
    from .scan import among_least

    k = F.when(draw(salt + "/scene", "scene") >= apply, F.col("_n")).otherwise(F.floor(F.col("_n") * (1 - ratio)))
    d = among_least(with_scene(df.withColumn("_u", draw(salt)), _n=F.count("*")).withColumn("_k", k), ["scene"], "_u", "point_idx", "_k", "_kept", most=most)
    return d.where(F.col("_kept") if labeled is None else F.col("_kept") | F.col(labeled)).drop("_u", "_n", "_k", "_kept")


def rotate(df: DataFrame, angle: Column | float, axis: str = "z", center: Sequence[Column] | None = None) -> DataFrame:
    """Coordinates turned about a centre (the middle of the bounding box if none), and normals, where there are any, about the origin."""
    angle = col(angle) if isinstance(angle, Column) else F.lit(float(angle))
    a, b = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    c = df
    if center is None:
        c = with_scene(df, **{f"_c{k}": (F.min(k) + F.max(k)) / 2 for k in XYZ})
        center = [F.col(f"_c{k}") for k in XYZ]

    def turned(names, mid):
        u, v = F.col(names[a]) - mid[a], F.col(names[b]) - mid[b]
        return {names[a]: F.cos(angle) * u - F.sin(angle) * v + mid[a], names[b]: F.sin(angle) * u + F.cos(angle) * v + mid[b]}

    new = turned(XYZ, center)
    if set(NORMAL) <= set(df.columns):
        new |= turned(NORMAL, [F.lit(0.0)] * 3)
    return c.withColumns(new).drop("_cx", "_cy", "_cz")


def random_rotate(df: DataFrame, angle=(-1.0, 1.0), axis: str = "z", p: float = 0.5, center=None, salt: str = "rotate") -> DataFrame:
    """By an angle of pi times a draw from the range, for scenes that are drawn with probability p."""
    turn = F.when(draw(salt + "/p", "scene") <= p, uniform(salt, *angle, "scene") * math.pi).otherwise(F.lit(0.0))
    return rotate(df, turn, axis, center)


def random_rotate_target(df: DataFrame, angles=(0.5, 1.0, 1.5), axis: str = "z", p: float = 0.75, center=None, salt: str = "turn") -> DataFrame:
    one = F.element_at(F.array(*(F.lit(float(a)) for a in angles)), (F.floor(draw(salt, "scene") * len(angles)) + 1).cast("int"))
    return rotate(df, F.when(draw(salt + "/p", "scene") <= p, one * math.pi).otherwise(F.lit(0.0)), axis, center)


def random_scale(df: DataFrame, scale=(0.95, 1.05), anisotropic: bool = False, salt: str = "scale") -> DataFrame:
    return df.withColumns({c: F.col(c) * uniform(f"{salt}/{c}" if anisotropic else salt, *scale, "scene") for c in XYZ})


def random_flip(df: DataFrame, p: float = 0.5, salt: str = "flip") -> DataFrame:
    """x and y change sign, each with probability p, normals with them."""
    out = {}
    for c, n in (("x", "nx"), ("y", "ny")):
        sign = F.when(draw(f"{salt}/{c}", "scene") < p, F.lit(-1.0)).otherwise(F.lit(1.0))
        out |= {k: F.col(k) * sign for k in (c, n) if k in df.columns}
    return df.withColumns(out)


def random_jitter(df: DataFrame, sigma: float = 0.01, clip: float = 0.05, salt: str = "jitter") -> DataFrame:
    return df.withColumns({c: F.col(c) + clamp(sigma * normal(f"{salt}/{c}"), -clip, clip) for c in XYZ})


def clip_gaussian_jitter(df: DataFrame, scalar: float = 0.02, keep: bool = False, salt: str = "gauss") -> DataFrame:
    """Jitter of a zero-mean normal over 1.96, cut to [-1, 1], times ``scalar``; ``keep`` leaves it in jitter_x, jitter_y, jitter_z."""
    j = {f"jitter_{c}": scalar * clamp(normal(f"{salt}/{c}") / 1.96, -1.0, 1.0) for c in XYZ}
    d = df.withColumns(j).withColumns({c: F.col(c) + F.col(f"jitter_{c}") for c in XYZ})
    return d if keep else d.drop(*j)


def _clip_color(c: Column) -> Column:
    return clamp(c, 0.0, 255.0)


def chromatic_translation(df: DataFrame, p: float = 0.95, ratio: float = 0.05, salt: str = "tint") -> DataFrame:
    on = draw(salt + "/p", "scene") < p
    return df.withColumns({c: F.when(on, _clip_color(F.col(c) + (draw(f"{salt}/{c}", "scene") - 0.5) * 255.0 * 2.0 * ratio)).otherwise(F.col(c)) for c in RGB})


def chromatic_jitter(df: DataFrame, p: float = 0.95, std: float = 0.005, salt: str = "speckle") -> DataFrame:
    on = draw(salt + "/p", "scene") < p
    return df.withColumns({c: F.when(on, _clip_color(F.col(c) + normal(f"{salt}/{c}") * std * 255.0)).otherwise(F.col(c)) for c in RGB})


def gray() -> Column:
    return 0.2989 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def color_gray_scale(df: DataFrame, p: float = 1.0, salt: str = "gray") -> DataFrame:
    on = draw(salt, "scene") < p
    return df.withColumns({c: F.when(on, gray()).otherwise(F.col(c)) for c in RGB})


def _blend(a: Column, b: Column, ratio: Column) -> Column:
    return _clip_color(ratio * a + (1.0 - ratio) * b)


def brightness(df: DataFrame, factor: Column) -> DataFrame:
    return df.withColumns({c: _blend(F.col(c), F.lit(0.0), factor) for c in RGB})


def contrast(df: DataFrame, factor: Column) -> DataFrame:
    """Blended with the scene's mean gray."""
    return with_scene(df, _mean=F.avg(gray())).withColumns({c: _blend(F.col(c), F.col("_mean"), factor) for c in RGB}).drop("_mean")


def saturation(df: DataFrame, factor: Column) -> DataFrame:
    return df.withColumns({c: _blend(F.col(c), gray(), factor) for c in RGB})


def hue(df: DataFrame, by: Column) -> DataFrame:
    h, s, v = rgb_to_hsv(*(F.col(c) / 255.0 for c in RGB))
    return df.withColumns({c: k * 255.0 for c, k in zip(RGB, hsv_to_rgb(h + by, s, v))})


def color_jitter(df: DataFrame, strength=(0.4, 0.4, 0.4, 0.1), p: float = 0.95, order: int = 0, salt: str = "mood") -> DataFrame:
    """Brightness, contrast, saturation and hue, each drawn for a scene with probability p, in one of their 24 orders."""
    b, c, s, h = strength

    def factor(name, amount):
        on = draw(f"{salt}/{name}/p", "scene") < p
        return F.when(on, uniform(f"{salt}/{name}", max(0.0, 1 - amount), 1 + amount, "scene")).otherwise(F.lit(1.0))

    shift = F.when(draw(f"{salt}/hue/p", "scene") < p, uniform(f"{salt}/hue", -h, h, "scene")).otherwise(F.lit(0.0))
    steps = [lambda d: brightness(d, factor("b", b)), lambda d: contrast(d, factor("c", c)), lambda d: saturation(d, factor("s", s)), lambda d: hue(d, shift)]
    for i in list(permutations(range(4)))[order % 24]:
        df = df.transform(steps[i])
    return df


def hue_saturation(df: DataFrame, hue_by: Column, saturate_by: Column) -> DataFrame:
    """The hue turned and the saturation scaled (cut at 1), values staying in 0..255."""
    h, s, v = rgb_to_hsv(*(F.col(c) for c in RGB))
    return df.withColumns({c: _clip_color(k) for c, k in zip(RGB, hsv_to_rgb(h + hue_by, clamp(s * (1.0 + saturate_by), 0.0, 1.0), v))})


def random_hue_saturation(df: DataFrame, hue_max: float = 0.5, saturation_max: float = 0.2, salt: str = "dye") -> DataFrame:
    return hue_saturation(df, uniform(salt + "/h", -hue_max, hue_max, "scene"), uniform(salt + "/s", -saturation_max, saturation_max, "scene"))


def color_drop(df: DataFrame, p: float = 0.2, keep: float = 0.0, salt: str = "drop") -> DataFrame:
    on = draw(salt, "scene") < p
    return df.withColumns({c: F.when(on, F.col(c) * keep).otherwise(F.col(c)) for c in RGB})


def shuffle(df: DataFrame, salt: str = "shuffle", most: int | None = None) -> DataFrame:
    """Points numbered anew in the order of their draws; the old number stays in ``old_idx``."""
    from .scan import rank_within

    d = rank_within(df.withColumns({"old_idx": F.col("point_idx"), "_u": draw(salt)}), ["scene"], "_u", "point_idx", rank="_new", most=most)
    return d.withColumn("point_idx", F.col("_new")).drop("_u", "_new")


def elastic_distortion(df: DataFrame, granularity: float = 0.2, magnitude: float = 0.4, salt: str = "elastic") -> DataFrame:
    """Points moved by smooth noise: a normal draw at each node of a coarse grid, two box blurs along each axis, trilinear interpolation.

    Each grid node is a function of its coordinates, so the blurred value at a node is the
    weighted sum of the 5x5x5 draws around it (weights of two boxes of three: 1 2 3 2 1 over
    9 along each axis); only nodes that points use are made.
    """
    g = float(granularity)
    low = with_scene(df, **{f"_l{c}": F.min(c) for c in XYZ})
    at = {c: (F.col(c) - F.col(f"_l{c}")) / g + 2.0 for c in XYZ}
    base = low.withColumns({f"_i{c}": F.floor(at[c]).cast("long") for c in XYZ}).withColumns({f"_f{c}": at[c] - F.floor(at[c]) for c in XYZ})
    corner = F.explode(F.array(*(F.struct(*(F.lit(b).cast("long").alias(c) for c, b in zip(XYZ, bits))) for bits in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)])))
    near = base.select(*KEY, *(f"_i{c}" for c in XYZ), *(f"_f{c}" for c in XYZ), corner.alias("_k"))
    near = near.select(*KEY, *((F.col(f"_i{c}") + F.col(f"_k.{c}")).alias(f"n{c}") for c in XYZ), F.expr(" * ".join(f"(CASE WHEN _k.{c} = 1 THEN _f{c} ELSE 1 - _f{c} END)" for c in XYZ)).alias("_w"))
    nodes = near.select("scene", *(f"n{c}" for c in XYZ)).distinct()
    steps = [F.array(*(F.struct(F.lit(d).cast("long").alias("d"), F.lit(w / 9.0).alias("w")) for d, w in zip(range(-2, 3), (1, 2, 3, 2, 1))))]
    wide = nodes
    for c in XYZ:
        wide = wide.withColumn(f"_s{c}", F.explode(steps[0]))
    around = [F.col(f"n{c}") + F.col(f"_s{c}.d") for c in XYZ]
    weight = F.col("_sx.w") * F.col("_sy.w") * F.col("_sz.w")
    noise = wide.groupBy("scene", *(f"n{c}" for c in XYZ)).agg(*(F.sum(weight * normal(f"{salt}/{c}", "scene", *around)).alias(f"_v{c}") for c in XYZ))
    moved = near.join(noise, ["scene", *(f"n{c}" for c in XYZ)]).groupBy(*KEY).agg(*(F.sum(F.col("_w") * F.col(f"_v{c}")).alias(f"_v{c}") for c in XYZ))
    return df.join(moved, KEY).withColumns({c: F.col(c) + magnitude * F.col(f"_v{c}") for c in XYZ}).drop(*(f"_v{c}" for c in XYZ))
