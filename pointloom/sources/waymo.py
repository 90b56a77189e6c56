"""Lidar frames kept as nested wire-format messages in record files: range images per laser and return.

Field numbers are those of the published frame message.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wire

# Field numbers of the frame format.
FRAME = {"context": 1, "timestamp": 2, "pose": 3, "lasers": 5}
CONTEXT = {"name": 1, "calibrations": 3}
CALIBRATION = {"laser": 1, "inclinations": 2, "least": 3, "most": 4, "extrinsic": 5}
LASER = {"laser": 1, "returns": (2, 3)}
IMAGE = {"ranges": 2, "pixel_pose": 4, "labels": 6}
MATRIX = {"data": 1, "shape": 2}
TOP = 1

SCHEMA = (
    "context string, timestamp long, laser int, return_no int, height int, width int, n_points long, pose array<double>, extrinsic array<double>, "
    "inclinations array<double>, ranges binary, channels int, pixel_pose binary, labels binary"
)
_ARROW = pa.schema([
    ("context", pa.string()), ("timestamp", pa.int64()), ("laser", pa.int32()), ("return_no", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("n_points", pa.int64()), ("pose", pa.list_(pa.float64())),
    ("extrinsic", pa.list_(pa.float64())), ("inclinations", pa.list_(pa.float64())), ("ranges", pa.binary()), ("channels", pa.int32()), ("pixel_pose", pa.binary()), ("labels", pa.binary()),
])


def _matrix(compressed, whole: bool = False) -> np.ndarray:
    """A compressed matrix as an array of its own shape."""
    m = wire.message(zlib.decompress(compressed))
    shape = wire.varints(wire.message(m[MATRIX["shape"]][-1])[1]).tolist()
    data = wire.varints(m[MATRIX["data"]]) if whole else wire.floats(m[MATRIX["data"]], "<f4")
    return data.reshape(shape)


def _transform(values: list) -> list[float]:
    return wire.floats(wire.message(values[-1])[1], "<f8").tolist() if values else np.eye(4).ravel().tolist()


def _one(m: dict[int, list], field: int, default=None):
    return m[field][-1] if m[field] else default


def _inclinations(calibration: dict[int, list], height: int) -> list[float]:
    """The elevation of each row from the top one down: as given, or even steps between the limits."""
    given = wire.floats(calibration[CALIBRATION["inclinations"]], "<f8")
    if not len(given):
        least, most = (wire.floats([_one(calibration, CALIBRATION[k], b"\0" * 8)], "<f8")[0] for k in ("least", "most"))
        given = (np.arange(height) + 0.5) / height * (most - least) + least
    return given[::-1].tolist()


def images_of(record) -> list[dict]:
    """A row for each range image of a frame, in the order of returns and lasers."""
    frame = wire.message(record)
    context = wire.message(_one(frame, FRAME["context"], b""))
    calibrations = {_one(c, CALIBRATION["laser"], 0): c for c in map(wire.message, context[CONTEXT["calibrations"]])}
    head = {"context": bytes(_one(context, CONTEXT["name"], b"")).decode("utf-8", "replace"), "timestamp": wire.signed(_one(frame, FRAME["timestamp"], 0)), "pose": _transform(frame[FRAME["pose"]])}
    out, poses = [], {}
    for laser in map(wire.message, frame[FRAME["lasers"]]):
        name = _one(laser, LASER["laser"], 0)
        calibration = calibrations.get(name, wire.message(b""))
        for return_no, field in enumerate(LASER["returns"], 1):
            image = wire.message(_one(laser, field, b""))
            if not image[IMAGE["ranges"]]:
                continue
            ranges = np.ascontiguousarray(_matrix(_one(image, IMAGE["ranges"])))
            labels = _one(image, IMAGE["labels"])
            # The pose of each pixel comes with the first return and holds for both.
            poses[name] = _one(image, IMAGE["pixel_pose"], poses.get(name))
            out.append(head | {
                "laser": name, "return_no": return_no, "height": ranges.shape[0], "width": ranges.shape[1], "n_points": int((ranges[..., 0] > 0).sum()), "extrinsic": _transform(calibration[CALIBRATION["extrinsic"]]),
                "inclinations": _inclinations(calibration, ranges.shape[0]), "ranges": ranges.astype("<f4").tobytes(), "channels": ranges.shape[2],
                "pixel_pose": _matrix(poses[name]).astype("<f4").tobytes() if name == TOP and poses[name] is not None else None, "labels": None if labels is None else _matrix(labels, True).astype("<i4").tobytes(),
            })
    return sorted(out, key=lambda r: (r["return_no"], r["laser"]))


def _images(it):
    for b in it:
        rows, held = [], 0
        for record in b.column(0):
            raw = record.as_buffer()
            if raw is None:
                continue
            for r in images_of(raw):
                rows.append(r)
                held += sum(len(r[c] or b"") for c in ("ranges", "pixel_pose", "labels"))
            if held > 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def images(records: DataFrame, labelled: bool = False) -> DataFrame:
    """The range images of frames (``record``), a row for each laser and return, with what their geometry needs.

    Lasers without an image are left out.  ``labelled``: only of frames whose first laser's first
    return has labels, as those of training splits are chosen.
    """
    out = records.select("record").mapInArrow(_images, SCHEMA)
    if not labelled:
        return out
    keys = ["context", "timestamp"]
    return out.join(out.where((F.col("laser") == TOP) & (F.col("return_no") == 1) & F.col("labels").isNotNull()).select(keys).distinct(), keys, "left_semi")


# Geometry


def _rotations(roll, pitch, yaw) -> np.ndarray:
    """Rotations about x, then y, then z, for arrays of angles."""
    cr, sr, cp, sp, cy, sy = np.cos(roll), np.sin(roll), np.cos(pitch), np.sin(pitch), np.cos(yaw), np.sin(yaw)
    rows = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def cartesian(ranges: np.ndarray, inclinations, extrinsic, pixel_pose: np.ndarray | None = None, pose=None) -> np.ndarray:
    """Places of all pixels of a range image, in the vehicle's coordinates.

    A pixel's azimuth goes from +pi at the left edge to -pi at the right one, less the laser's
    own heading; its elevation is its row's.  Pixels with a pose of their own (roll, pitch,
    yaw, x, y, z in the world) are taken to the world by it and back by the frame's pose.
    """
    height, width = ranges.shape
    m = np.asarray(extrinsic, np.float64).reshape(4, 4)
    azimuth = (2 * (width - np.arange(width) - 0.5) / width - 1) * np.pi - np.arctan2(m[1, 0], m[0, 0])
    rows = np.asarray(inclinations, np.float64)[:height, None]
    p = ranges.astype(np.float64)[..., None] * np.stack([np.cos(azimuth) * np.cos(rows), np.sin(azimuth) * np.cos(rows), np.broadcast_to(np.sin(rows), (height, width))], -1)
    p = p @ m[:3, :3].T + m[:3, 3]
    if pixel_pose is not None:
        own = pixel_pose.astype(np.float64)
        p = np.einsum("hwij,hwj->hwi", _rotations(own[..., 0], own[..., 1], own[..., 2]), p) + own[..., 3:]
        back = np.linalg.inv(np.asarray(pose, np.float64).reshape(4, 4))
        p = p @ back[:3, :3].T + back[:3, 3]
    return p


_POINTS = "context string, timestamp long, point_idx long, laser int, return_no int, pixel int, x double, y double, z double, range double, intensity double, elongation double, segment int, instance int"


def _points(it):
    names = [c.split()[0] for c in _POINTS.split(", ")]
    for b in it:
        for r in b.to_pylist():
            h, w = r["height"], r["width"]
            a = np.frombuffer(r["ranges"], "<f4").reshape(h, w, r["channels"])
            poses = None if r["pixel_pose"] is None else np.frombuffer(r["pixel_pose"], "<f4").reshape(h, w, 6)
            at = np.flatnonzero(a[..., 0].ravel() > 0)
            xyz = cartesian(a[..., 0], r["inclinations"], r["extrinsic"], poses, r["pose"]).reshape(-1, 3)[at]
            labels = np.zeros((len(at), 2), np.int32) if r["labels"] is None else np.frombuffer(r["labels"], "<i4").reshape(h * w, -1)[at]
            polar, n = a.reshape(h * w, -1)[at].astype(np.float64), len(at)
            more = [polar[:, i] if i < polar.shape[1] else np.zeros(n) for i in range(3)]
            one = lambda v, t: pa.array([v] * n, t)
            columns = [one(r["context"], pa.string()), one(r["timestamp"], pa.int64()), pa.array(r["first"] + np.arange(n)), one(r["laser"], pa.int32()), one(r["return_no"], pa.int32()), pa.array(at.astype(np.int32))]
            columns += [pa.array(np.ascontiguousarray(v)) for v in (*xyz.T, *more)] + [pa.array(np.ascontiguousarray(labels[:, i])) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def points(images: DataFrame) -> DataFrame:
    """The pixels with a range above 0 as points in the vehicle's coordinates.

    ``point_idx`` counts within the frame by return, laser and pixel: an image starts where the
    ones before it end, so only a frame's few images are ordered, never its points.  ``segment``
    and ``instance`` are 0 where an image has no labels.
    """
    w = Window.partitionBy("context", "timestamp").orderBy("return_no", "laser").rowsBetween(Window.unboundedPreceding, -1)
    counts = images.select("context", "timestamp", "laser", "return_no", "n_points").withColumn("first", F.coalesce(F.sum("n_points").over(w), F.lit(0))).drop("n_points")
    return images.join(counts, ["context", "timestamp", "laser", "return_no"]).mapInArrow(_points, _POINTS)


# Writing frames


def _packed(values: Iterable[float]) -> bytes:
    return b"".join(wire.put(1, float(v)) for v in values)


def matrix_bytes(a: np.ndarray) -> bytes:
    """A compressed matrix of 32-bit floats or of whole numbers."""
    data = a.astype("<f4").tobytes() if a.dtype.kind == "f" else b"".join(map(wire.number, a.ravel().tolist()))
    return zlib.compress(wire.put(MATRIX["data"], data) + wire.put(MATRIX["shape"], b"".join(wire.put(1, int(n)) for n in a.shape)))


def frame_record(context: str, timestamp: int, pose: Iterable[float], lasers: list[dict]) -> bytes:
    """A frame's message.  Each laser: laser, extrinsic, inclinations or (least, most), and returns, a list of dicts with ranges, and pixel_pose and labels where it has them."""
    calibrations, bodies = b"", b""
    for x in lasers:
        c = wire.put(CALIBRATION["laser"], x["laser"])
        if x.get("inclinations") is not None:
            c += b"".join(wire.put(CALIBRATION["inclinations"], float(v)) for v in x["inclinations"])
        else:
            c += wire.put(CALIBRATION["least"], float(x["least"])) + wire.put(CALIBRATION["most"], float(x["most"]))
        calibrations += wire.put(CONTEXT["calibrations"], c + wire.put(CALIBRATION["extrinsic"], _packed(x["extrinsic"])))
        body = wire.put(LASER["laser"], x["laser"])
        for field, image in zip(LASER["returns"], x["returns"]):
            if image is not None:
                body += wire.put(field, b"".join(wire.put(IMAGE[k], matrix_bytes(image[k])) for k in IMAGE if image.get(k) is not None))
        bodies += wire.put(FRAME["lasers"], body)
    return wire.put(FRAME["context"], wire.put(CONTEXT["name"], context) + calibrations) + wire.put(FRAME["timestamp"], timestamp) + wire.put(FRAME["pose"], _packed(pose)) + bodies
