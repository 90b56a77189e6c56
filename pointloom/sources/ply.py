"""PLY meshes: ascii and both binary byte orders, scalar and list properties."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame

from .files import FileReader, FileSource, read_bytes, write_bytes

#: Scalar types of the format with their aliases.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1",
    "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
    "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def parse(data: bytes) -> dict[str, dict[str, list | np.ndarray]]:
    """Elements by name, each with its properties by name."""
    head, sep, body = data.partition(b"end_header")
    if not data.startswith(b"ply") or not sep:
        raise ValueError("not a PLY file")
    body = body[2:] if body.startswith(b"\r\n") else body[1:]
    order, elements = None, []
    for line in head.decode("ascii", "replace").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[word[1]]
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            elements[-1][2].append((word[4], word[2], word[3]) if word[1] == "list" else (word[2], None, word[1]))
    tokens = iter(body.split()) if order == "" else None
    at, out = 0, {}
    for name, n, properties in elements:
        if tokens is None and all(size is None for _, size, _ in properties):
            kind = np.dtype([(p, order + TYPES[t]) for p, _, t in properties])
            rows = np.frombuffer(body, kind, n, at)
            at += n * kind.itemsize
            out[name] = {p: rows[p] for p, *_ in properties}
            continue
        columns: dict[str, list] = {p: [] for p, *_ in properties}

        def value(t: str):
            nonlocal at
            if tokens is not None:
                return np.dtype(TYPES[t]).type(next(tokens)).item()
            kind = np.dtype(order + TYPES[t])
            v = np.frombuffer(body, kind, 1, at)[0].item()
            at += kind.itemsize
            return v

        for _ in range(n):
            for p, size, t in properties:
                if size is None:
                    columns[p].append(value(t))
                elif tokens is not None:
                    columns[p].append([value(t) for _ in range(value(size))])
                else:
                    k, kind = value(size), np.dtype(order + TYPES[t])
                    columns[p].append(np.frombuffer(body, kind, k, at).tolist())
                    at += k * kind.itemsize
        out[name] = columns
    return out


class PlyReader(FileReader):
    """Options: path; element (vertex)."""

    suffix = ".ply"

    def rows(self, paths):
        for path in paths:
            e = parse(read_bytes(path)).get(self.options.get("element", "vertex"), {})
            scene = path.rpartition("/")[2].removesuffix(".ply")
            names = [f.name for f in self.schema.fields[3:]]
            n = len(next(iter(e.values()), []))
            columns = []
            for f, name in zip(self.schema.fields[3:], names):
                v = e.get(name)
                plain = [None] * n if v is None else v.tolist() if isinstance(v, np.ndarray) else v
                columns.append([float(x) for x in plain] if f.dataType.typeName() == "double" and v is not None else plain)
            for i, row in enumerate(zip(*columns)):
                yield (path, scene, i, *row)


class PlySource(FileSource):
    """``spark.read.format("ply")``: path, scene, idx, then vertex columns or, with element=face, ``vertex_indices``."""

    reader_class = PlyReader

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        head = "path string, scene string, idx long, "
        if self.options.get("element", "vertex") == "face":
            return head + "vertex_indices array<int>"
        return head + "x double, y double, z double, nx double, ny double, nz double, red int, green int, blue int, alpha int, label int"


def write_ply(df: DataFrame, root: str) -> int:
    """One binary PLY file per scene with coordinates and, if there are any, colours.  Returns the files written."""
    color = {"r", "g", "b"} <= set(df.columns)

    def of(key, pdf):
        import pandas as pd

        p = pdf.sort_values("point_idx")
        kind = np.dtype([(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("red", "green", "blue")] if color else []))
        rows = np.zeros(len(p), kind)
        for c in "xyz":
            rows[c] = p[c]
        for c, s in zip(("red", "green", "blue"), "rgb") if color else ():
            rows[c] = p[s].clip(0, 255)
        head = io.StringIO()
        head.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {len(p)}\n")
        head.writelines(f"property {'float' if c in 'xyz' else 'uchar'} {c}\n" for c in kind.names)
        write_bytes(f"{root.rstrip('/')}/{key[0]}.ply", head.getvalue().encode() + b"end_header\n" + rows.tobytes())
        return pd.DataFrame({"scene": [str(key[0])]})

    return df.groupBy("scene").applyInPandas(of, "scene string").count()
