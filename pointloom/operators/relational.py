"""Dataset preparation as joins: lookups, chains, painted segments, meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snowflake(facts: DataFrame, *lookups: tuple[DataFrame, str, str]) -> DataFrame:
    """Facts with each dimension (frame, fact's key, dimension's key) looked up; Catalyst chooses broadcasts by size."""
    for dim, left, right in lookups:
        facts = facts.join(dim, F.col(left) == dim[right])
    return facts


def remap_categories(df: DataFrame, dim: DataFrame, raw: str, valid: Sequence[int] | None = None, default: int = 0) -> DataFrame:
    """Raw categories to class ids by the first match in ``dim`` (raw, id, pos), else the default; ids outside ``valid`` become -1."""
    first = dim.groupBy("raw").agg(F.min_by("id", "pos").alias("id"))
    out = df.join(first.withColumnRenamed("raw", raw), raw, "left").withColumn("id", F.coalesce("id", F.lit(default)))
    return out if valid is None else out.withColumn("id", F.when(F.col("id").isin(*valid), F.col("id")).otherwise(F.lit(-1)))


def class_positions(df: DataFrame, column: str, valid: Sequence[int]) -> DataFrame:
    """Class ids by their place in the valid list; others -1."""
    at = F.array_position(F.array(*(F.lit(v) for v in valid)), F.col(column)) - 1
    return df.withColumn(column, at.cast("long"))


def paint_segments(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """Labels of vertices (scene, vertex, segment_id) by segment groups (scene, segment_id, group_no, label); the last group wins, none gives -1."""
    last = members.groupBy("scene", "segment_id").agg(F.max_by("label", "group_no").alias("label"), F.max("group_no").alias("group_no"))
    return vertices.join(last, ["scene", "segment_id"], "left").withColumns({"label": F.coalesce("label", F.lit(-1)), "group_no": F.coalesce("group_no", F.lit(-1))})


def mesh_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertex normals: sums of their faces' cross products, so by area, normalised with 1e-8.

    ``vertices``: scene, vertex, x, y, z; ``faces``: scene, face, a, b, c.  Corners meet their
    vertices in three joins and normals are summed before the shuffle.
    """
    f = faces
    for k in "abc":
        f = f.join(vertices.select("scene", F.col("vertex").alias(k), *(F.col(c).alias(k + c) for c in "xyz")), ["scene", k])
    u = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    v = [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    per = f.select("scene", F.explode(F.array("a", "b", "c")).alias("vertex"), *(e.alias(f"n{c}") for e, c in zip(n, "xyz")))
    s = per.groupBy("scene", "vertex").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"))
    length = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in "yz"), F.col("nx") * F.col("nx"))) + 1e-8
    out = vertices.join(s.withColumn("_l", length), ["scene", "vertex"], "left")
    return out.withColumns({f"n{c}": F.coalesce(F.col(f"n{c}") / F.col("_l"), F.lit(0.0)) for c in "xyz"}).drop("_l")


def sweeps_by_prev(samples: DataFrame, rounds: int = 40, limit: int = 10) -> DataFrame:
    """(id, hop, prev_id) up to ``limit`` hops for linked lists that only have ``prev``: hop tables double their reach."""
    one = samples.where("prev is not null").select("id", F.lit(1).alias("hop"), F.col("prev").alias("prev_id"))
    out, reach = one, 1
    while reach < limit:
        far = out.where(F.col("hop") == reach).select("id", F.col("prev_id").alias("_mid"))
        more = far.join(out.select(F.col("id").alias("_mid"), F.col("hop").alias("_h"), "prev_id"), "_mid").select("id", (F.col("_h") + reach).alias("hop"), "prev_id")
        out = out.unionByName(more.where(F.col("hop") <= limit))
        reach *= 2
    return out


def convolution_pairs(voxels: DataFrame, kernel: int = 3) -> DataFrame:
    """(scene, out, offset, in) of a submanifold convolution: occupied voxels and their occupied neighbours by kernel offset."""
    h = kernel // 2
    steps = F.sequence(F.lit(-h), F.lit(h))
    o = voxels.select("scene", F.col("voxel_id").alias("out"), "gx", "gy", "gz").withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("dz", F.explode(steps))
    o = o.select("scene", "out", (((F.col("dx") + h) * kernel + F.col("dy") + h) * kernel + F.col("dz") + h).alias("offset"), *((F.col(f"g{c}") + F.col(f"d{c}")).alias(f"g{c}") for c in "xyz"))
    return o.join(voxels.select("scene", F.col("voxel_id").alias("in"), "gx", "gy", "gz"), ["scene", "gx", "gy", "gz"]).select("scene", "out", "offset", "in")


def top_lidar_matrices(frames: DataFrame) -> DataFrame:
    """Sensor-to-top rotation (9) and shift (3) from the quaternions and shifts of sensor, ego and top, by Arrow batches on one row per frame.

    Columns: id, then q (w x y z) and t (x y z) arrays sensor_q, sensor_t, ego_q, ego_t, top_q, top_t, top_ego_q, top_ego_t.
    """
    import pandas as pd

    def of(it):
        import numpy as np

        def matrices(q):
            w, x, y, z = (np.stack(q).T / np.linalg.norm(np.stack(q), axis=1)).astype(float)
            return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)

        for p in it:
            if not len(p):
                continue
            s, e, t, te = (matrices(p[f"{n}_q"]) for n in ("sensor", "ego", "top", "top_ego"))
            st, et, tt, tet = (np.stack(p[f"{n}_t"])[:, :, None] for n in ("sensor", "ego", "top", "top_ego"))
            back = np.linalg.inv(te @ t)
            r = back @ e @ s
            shift = back @ (e @ st + et - te @ tt - tet)
            yield pd.DataFrame({"id": p["id"], "rotation": list(r.reshape(-1, 9)), "shift": list(shift[:, :, 0])})

    return frames.mapInPandas(of, "id long, rotation array<double>, shift array<double>")


def first_keyword(df: DataFrame, name: str, groups: Sequence[tuple[str, float]], default: float) -> DataFrame:
    """Each name's value by the first keyword it holds."""
    out = F.lit(default)
    for word, value in reversed(groups):
        out = F.when(F.col(name).contains(word), F.lit(value)).otherwise(out)
    return df.withColumn("value", out)


def ranked(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
