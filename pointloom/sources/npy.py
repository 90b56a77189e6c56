"""Scenes as folders of ``.npy`` files, one per column."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FileReader, FileSource, listing, read_bytes, write_bytes

#: Asset to columns.
ASSETS = {
    "coord": ("x", "y", "z"),
    "color": ("r", "g", "b"),
    "normal": ("nx", "ny", "nz"),
    "strength": ("strength",),
    "segment": ("segment",),
    "instance": ("instance",),
}
LABELS = ("segment", "instance")
_KINDS = {c: ("long" if c in LABELS else "double") for cs in ASSETS.values() for c in cs}
SCHEMA = "split string, scene string, point_idx long, " + ", ".join(f"{c} {t}" for c, t in _KINDS.items())


class NpySceneReader(FileReader):
    """Options: path; rename, like ``segment20:segment``; skip_bad.  Assets outside the asked columns are not read."""

    suffix = ".npy"

    def groups(self):
        by: dict[str, list[str]] = {}
        for p in listing(self.options["path"], self.suffix):
            by.setdefault(p.rpartition("/")[0], []).append(p)
        return list(by.values())

    def rows(self, paths):
        rename = dict(x.split(":") for x in self.options.get("rename", "").split(",") if x)
        *_, split, scene = paths[0].rpartition("/")[0].split("/")
        wanted = {f.name for f in self.schema.fields}
        columns: dict[str, np.ndarray] = {}
        for p in paths:
            asset = p.rpartition("/")[2].removesuffix(".npy")
            asset = rename.get(asset, asset)
            if asset not in ASSETS or not wanted & set(ASSETS[asset]):
                continue
            try:
                a = np.load(io.BytesIO(read_bytes(p)), allow_pickle=False)
            except (ValueError, OSError):
                if self.options.get("skip_bad", "false") == "true":
                    return
                raise
            a = a.reshape(len(a), -1)
            columns |= {c: a[:, i] for i, c in enumerate(ASSETS[asset])}
        n = max((len(v) for v in columns.values()), default=0)
        arrays = []
        for f in self.schema.fields:
            kind = pa.string() if f.name in ("split", "scene") else pa.int64() if f.name == "point_idx" or f.name in LABELS else pa.float64()
            if f.name in ("split", "scene"):
                v = pa.array([split if f.name == "split" else scene] * n, kind)
            elif f.name == "point_idx":
                v = pa.array(np.arange(n), kind)
            elif f.name in columns:
                v = pa.array(columns[f.name].astype(np.int64 if kind == pa.int64() else np.float64), kind)
            else:
                v = pa.array([-1] * n, kind) if f.name in LABELS else pa.nulls(n, kind)
            arrays.append(v)
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema.fields])


class NpySceneSource(FileSource):
    """``spark.read.format("npy_scene")``: split and scene by folder, missing labels -1, other missing columns null."""

    reader_class = NpySceneReader

    @classmethod
    def name(cls):
        return "npy_scene"

    def schema(self):
        return SCHEMA


def scenes(spark: SparkSession, root: str, split: str | list[str], names: DataFrame | None = None, columns=None, rename: str = "") -> DataFrame:
    """Points of one or more splits (folders), of the scenes in a list if given; ``columns`` limit the assets that are read."""
    parts = []
    for s in [split] if isinstance(split, str) else split:
        r = spark.read.format("npy_scene").option("path", f"{root.rstrip('/')}/{s}").option("rename", rename)
        if columns:
            kinds = {"split": "string", "scene": "string", "point_idx": "long"} | _KINDS
            r = r.schema(", ".join(f"{c} {kinds[c]}" for c in ("split", "scene", "point_idx", *columns)))
        parts.append(r.load())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if names is None else out.join(names.select("scene").distinct(), "scene", "left_semi")


def with_labeled_index(df: DataFrame, labeled: DataFrame, ignore: int = -1) -> DataFrame:
    """Only labels of the points in ``labeled`` (scene, point_idx) are kept; ``is_labeled`` tells which."""
    hit = labeled.select("scene", "point_idx").distinct().withColumn("is_labeled", F.lit(True))
    d = df.join(hit, ["scene", "point_idx"], "left").withColumn("is_labeled", F.coalesce("is_labeled", F.lit(False)))
    return d.withColumn("segment", F.when(F.col("is_labeled"), F.col("segment")).otherwise(F.lit(ignore)))


def repeated(df: DataFrame, loop: int) -> DataFrame:
    """The dataset ``loop`` times, told apart by ``loop_no``."""
    return df.withColumn("loop_no", F.explode(F.sequence(F.lit(0), F.lit(loop - 1))))


def concatenated(*frames: DataFrame) -> DataFrame:
    """All frames, with ``dataset`` as their number; columns that one lacks are null."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("dataset", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def write_scenes(df: DataFrame, root: str, assets=("coord", "color", "normal", "segment", "instance")) -> int:
    """``root/split/scene/asset.npy``: each scene is one group, since a file holds a whole scene.  Returns the scenes written.

    Assets of which a column is missing are left out.
    """
    have = [a for a in assets if set(ASSETS[a]) <= set(df.columns)]

    def of(key, pdf):
        import pandas as pd

        p = pdf.sort_values("point_idx")
        for a in have:
            kind = np.uint8 if a == "color" else np.int32 if a in LABELS else np.float32
            buf = io.BytesIO()
            np.save(buf, p[list(ASSETS[a])].to_numpy().astype(kind).squeeze() if a in LABELS else p[list(ASSETS[a])].to_numpy().astype(kind))
            write_bytes(f"{root.rstrip('/')}/{key[0]}/{key[1]}/{a}.npy", buf.getvalue())
        return pd.DataFrame({"scene": [str(key[1])], "n": [len(p)]})

    return df.groupBy("split", "scene").applyInPandas(of, "scene string, n long").count()


