"""Frames written as record files and read back: damage, and points from range images."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..functions.shared import new_path
from ..sources import events, tfrecord, waymo
from ..sources.files import write_bytes
from . import query
from .views import LI, points_li, r6 as r6_sql, table

_ROWS = 4


def _frame(scene: int, rows: list[dict]) -> bytes:
    """A line item is a pixel: its laser by instance, its return by part; in each image the items fill columns of four rows."""
    by: dict[tuple[int, int], list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["point_idx"]):
        by.setdefault((1 + r["instance"] % 5, 1 + r["part"] % 2), []).append(r)
    lasers = []
    for laser in sorted({k[0] for k in by}):
        a = 0.7 * laser
        turn = [math.cos(a), -math.sin(a), 0, laser, math.sin(a), math.cos(a), 0, 0.5, 0, 0, 1, 1.5, 0, 0, 0, 1]
        one = {"laser": laser, "extrinsic": turn, "returns": []} | ({"inclinations": [-0.3, -0.1, 0.05, 0.2]} if laser == 1 else {"least": -0.4, "most": 0.5})
        size = max(len(by.get((laser, n), ())) for n in (1, 2))
        width = -(-size // _ROWS)
        for n in (1, 2):
            items = by.get((laser, n))
            if items is None:
                one["returns"].append(None)
                continue
            image, labels, poses = np.full((_ROWS, width, 4), -1, np.float32), np.zeros((_ROWS, width, 2), np.int32), np.zeros((_ROWS, width, 6), np.float32)
            for k, r in enumerate(items):
                row, column = k % _ROWS, k // _ROWS
                image[row, column] = (0 if r["z"] == 0 else r["x"], r["strength"], r["z"], 0)
                labels[row, column] = (r["instance"], r["segment"] + 1)
            rows_at, columns_at = np.mgrid[:_ROWS, :width]
            poses[:] = np.stack([rows_at / 64, columns_at % 8 / 128, (rows_at + columns_at) % 16 / 8, rows_at, columns_at / 4, np.full_like(rows_at, 2)], -1)
            first = laser == 1
            one["returns"].append({"ranges": image, "labels": labels if first else None, "pixel_pose": poses if first and n == 1 else None})
        if laser == 1 and one["returns"][0] is None:
            one["returns"][0] = {"ranges": np.full((_ROWS, width, 4), -1, np.float32), "pixel_pose": poses}
        lasers.append(one)
    a = scene / 128
    pose = [math.cos(a), -math.sin(a), 0, scene % 100, math.sin(a), math.cos(a), 0, -(scene % 50), 0, 0, 1, 0.25, 0, 0, 0, 1]
    return waymo.frame_record(f"scene-{scene}", scene, pose, lasers)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """scene, record: a frame of each scene."""
    p = points_li(spark, sf).select("scene", "point_idx", "x", "z", "strength", "segment", "instance", "part")

    def encoded(key, t):
        return pa.table({"scene": [key[0].as_py()], "record": [_frame(key[0].as_py(), t.to_pylist())]})

    return p.groupBy("scene").applyInArrow(encoded, "scene long, record binary")


_PIXELS = f"""{LI}, im AS (SELECT *, CAST(1 + instance % 5 AS INT) AS laser, CAST(1 + part % 2 AS INT) AS return_no, row_number() OVER (PARTITION BY scene, instance % 5, part % 2 ORDER BY point_idx) - 1 AS k FROM li),
w AS (SELECT scene, laser, CAST(ceil(max(k + 1) / 4.0) AS BIGINT) AS width FROM im GROUP BY ALL),
px AS (SELECT im.scene, laser, return_no, CAST(k % 4 AS INT) AS row, CAST(k // 4 AS INT) AS col, width, x AS range, CAST(CAST(strength AS FLOAT) AS DOUBLE) AS intensity, z AS elongation,
    CASE WHEN laser = 1 THEN segment + 1 ELSE 0 END AS label, CASE WHEN laser = 1 THEN instance ELSE 0 END AS inst FROM im JOIN w USING (scene, laser) WHERE z <> 0)"""
_GEOMETRY = """,
g0 AS (SELECT *, 0.7::DOUBLE * laser AS a, (2 * (width - col - 0.5::DOUBLE) / width - 1) * pi() - atan2(sin(0.7::DOUBLE * laser), cos(0.7::DOUBLE * laser)) AS az,
    CASE WHEN laser = 1 THEN ([0.2, 0.05, -0.1, -0.3]::DOUBLE[])[row + 1] ELSE (3 - row + 0.5::DOUBLE) / 4 * 0.9::DOUBLE - 0.4::DOUBLE END AS inc FROM px),
g1 AS (SELECT *, range * cos(az) * cos(inc) AS lx, range * sin(az) * cos(inc) AS ly, range * sin(inc) AS lz FROM g0),
g2 AS (SELECT *, cos(a) * lx - sin(a) * ly + laser AS vx, sin(a) * lx + cos(a) * ly + 0.5::DOUBLE AS vy, lz + 1.5::DOUBLE AS vz, row / 64.0::DOUBLE AS ro, col % 8 / 128.0::DOUBLE AS pi_, (row + col) % 16 / 8.0::DOUBLE AS ya, scene / 128.0::DOUBLE AS f FROM g1),
g3 AS (SELECT *,
    cos(ya) * cos(pi_) * vx + (cos(ya) * sin(pi_) * sin(ro) - sin(ya) * cos(ro)) * vy + (cos(ya) * sin(pi_) * cos(ro) + sin(ya) * sin(ro)) * vz + row - scene % 100 AS wx,
    sin(ya) * cos(pi_) * vx + (sin(ya) * sin(pi_) * sin(ro) + cos(ya) * cos(ro)) * vy + (sin(ya) * sin(pi_) * cos(ro) - cos(ya) * sin(ro)) * vz + col / 4.0::DOUBLE + scene % 50 AS wy,
    -sin(pi_) * vx + cos(pi_) * sin(ro) * vy + cos(pi_) * cos(ro) * vz + 2 - 0.25::DOUBLE AS wz FROM g2),
g4 AS (SELECT *, CASE WHEN laser = 1 THEN cos(f) * wx + sin(f) * wy ELSE vx END AS fx, CASE WHEN laser = 1 THEN cos(f) * wy - sin(f) * wx ELSE vy END AS fy, CASE WHEN laser = 1 THEN wz ELSE vz END AS fz FROM g3)"""


@query("range_image_points", f"""WITH {_PIXELS}{_GEOMETRY}
SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY return_no, laser, row, col) - 1 AS point_idx, laser, return_no, {r6_sql('fx', 4)} AS x, {r6_sql('fy', 4)} AS y, {r6_sql('fz', 4)} AS z,
    {r6_sql('tanh(intensity)')} AS strength, elongation, CAST(label - 1 AS BIGINT) AS segment, CAST(inst AS INT) AS instance FROM g4""")  # fmt: skip
def range_image_points(spark, sf):
    """Frames written as record files, read, and their pixels turned into points."""
    folder = new_path(spark, "lidar-frames")
    spark.dataSource.register(tfrecord.TfRecordSource)
    _frames(spark, sf).select("record").write.format("tfrecord").option("path", folder).mode("append").save()
    records = spark.read.format("tfrecord").option("path", folder).option("split_bytes", 8 << 20).load().where("kind = 'record'")
    p = waymo.points(waymo.images(records))
    xyz = [r6(c, 4).alias(c) for c in "xyz"]
    return p.select(F.col("timestamp").alias("scene"), "point_idx", "laser", "return_no", *xyz, r6(F.tanh("intensity")).alias("strength"), "elongation", (F.col("segment") - 1).cast("long").alias("segment"), "instance")


def _damaged(it, folder: str):
    """One file a task, in which every seventh scene has a byte turned over."""
    import uuid

    out, names = bytearray(), []
    for b in it:
        for scene, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one = bytearray(tfrecord.framed(record))
            if scene % 7 == 3:
                one[len(one) // 2] ^= 255
            out += one
            if len(out) > 16 << 20:
                names.append(f"{folder}/{uuid.uuid4().hex}.tfrecord")
                write_bytes(names[-1], bytes(out))
                out.clear()
    if out:
        names.append(f"{folder}/{uuid.uuid4().hex}.tfrecord")
        write_bytes(names[-1], bytes(out))
    yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})


@query("record_salvage", f"""WITH {_PIXELS}, n AS (SELECT scene, count(*) AS n_points FROM px WHERE scene % 7 <> 3 GROUP BY scene),
s AS (SELECT DISTINCT l_suppkey AS scene FROM lineitem)
SELECT 'record' AS kind, CAST(NULL AS VARCHAR) AS reason, scene, coalesce(n_points, 0) AS n FROM s LEFT JOIN n USING (scene) WHERE scene % 7 <> 3
UNION ALL SELECT 'gap', 'the data''s checksum differs', -1, count(*) FROM s WHERE scene % 7 = 3 HAVING count(*) > 0""")  # fmt: skip
def record_salvage(spark, sf):
    """Record files with damage: valid frames with their points, and the gaps that are logged."""
    folder = new_path(spark, "damaged-frames")
    spark.dataSource.register(tfrecord.TfRecordSource)
    made = _frames(spark, sf).mapInArrow(lambda it: _damaged(it, folder), "path string").checkpoint()
    made.count()
    read = spark.read.format("tfrecord").option("path", folder).option("split_bytes", 1 << 20).load()
    counts = waymo.images(read.where("kind = 'record'")).groupBy(F.col("timestamp").alias("scene")).agg(F.sum("n_points").alias("n"))
    good = counts.select(F.lit("record").alias("kind"), F.lit(None).cast("string").alias("reason"), "scene", "n")
    gaps = read.where("kind = 'gap'").groupBy("kind", "reason").agg(F.count("*").alias("n"))
    return good.unionByName(gaps.select("kind", "reason", F.lit(-1).cast("long").alias("scene"), "n"))


@query("scalar_events", f"SELECT event_type AS name, event_id AS iteration, {r6_sql('CAST(CAST(value AS FLOAT) AS DOUBLE)')} AS value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL")
def scalar_events(spark, sf):
    """Every event's value as a scalar of an event file, written and read back."""
    folder = new_path(spark, "scalars")
    spark.dataSource.register(tfrecord.TfRecordSource)
    events.write_scalars(table(spark, sf, "events").selectExpr("event_type as name", "event_id as iteration", "value"), folder)
    return events.read_scalars(spark, folder).select("name", "iteration", r6("value").alias("value"))
