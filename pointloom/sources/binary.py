"""Fixed-width binary files, such as lidar sweeps and their labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import FileReader, FileSource, read_bytes, write_bytes


class FixedBinaryReader(FileReader):
    """Options: path; columns (x,y,z,strength,ring); dtype (<f4); suffix (.bin)."""

    @property
    def suffix(self):
        return self.options.get("suffix", ".bin")

    def rows(self, paths):
        names = self.options.get("columns", "x,y,z,strength,ring").split(",")
        for path in paths:
            data = read_bytes(path)
            kind = np.dtype(self.options.get("dtype", "<f4"))
            n = len(data) // (kind.itemsize * len(names))
            a = np.frombuffer(data, kind, n * len(names)).reshape(n, len(names))
            head = [pa.array([path] * n), pa.array(np.arange(n))]
            yield pa.RecordBatch.from_arrays(head + [pa.array(a[:, i].astype(np.float64)) for i in range(len(names))], names=["path", "point_idx", *names])


class FixedBinarySource(FileSource):
    """``spark.read.format("fixed_binary")``: path, point_idx and the named columns as doubles."""

    reader_class = FixedBinaryReader

    @classmethod
    def name(cls):
        return "fixed_binary"

    def schema(self):
        names = self.options.get("columns", "x,y,z,strength,ring").split(",")
        return "path string, point_idx long, " + ", ".join(f"{c} double" for c in names)


def lidar_points(sweeps: DataFrame, labels: DataFrame, classes: dict[int, int], ignore: int = -1) -> DataFrame:
    """Sweep points with strength in 0..1 and raw labels (frame, point_idx, label) mapped to classes; ``frame`` names the sweep."""
    mapped = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in classes.items() for v in kv)), F.col("label").cast("int")), F.lit(ignore))
    return sweeps.join(labels, ["frame", "point_idx"], "left").withColumns({"strength": F.col("strength") / 255.0, "segment": mapped}).drop("label")


def write_labels(df: DataFrame, root: str, dtype: str = "<u4", suffix: str = ".label", inverse: dict[int, int] | None = None, shift: int = 0) -> int:
    """One binary label file per scene, in point order; labels mapped back by ``inverse`` and shifted.  Returns the files written."""

    def of(key, pdf):
        import pandas as pd

        p = pdf.sort_values("point_idx")
        v = p["pred"].map(inverse) if inverse else p["pred"]
        write_bytes(f"{root.rstrip('/')}/{key[0]}{suffix}", (v + shift).to_numpy().astype(dtype).tobytes())
        return pd.DataFrame({"scene": [str(key[0])]})

    return df.select("scene", "point_idx", "pred").groupBy("scene").applyInPandas(of, "scene string").count()
