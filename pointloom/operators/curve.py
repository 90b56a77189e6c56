"""Space-filling curves: codes, ranks and patches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import morton, unmorton
from .scan import rank_within

MAX_BITS = 16
ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")


def depth_of(df: DataFrame) -> DataFrame:
    """Bits that the largest cell of each scene needs."""
    most = F.greatest(F.max("gx"), F.max("gy"), F.max("gz"))
    return df.groupBy("scene").agg(F.length(F.conv((most + 1).cast("string"), 10, 2)).alias("depth"))


def _hilbert_axes(xyz, bits: int):
    """Cells (three uint64 arrays) to transposed Hilbert axes, by Skilling's method."""
    import numpy as np

    x = [a.copy() for a in xyz]
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(3):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= one
    for i in (1, 2):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[2] & q) != 0, t ^ (q - one), t)
        q >>= one
    return [a ^ t for a in x]


def _hilbert_cells(axes, bits: int):
    """The inverse of :func:`_hilbert_axes`."""
    import numpy as np

    x = [a.copy() for a in axes]
    one = np.uint64(1)
    t = x[2] >> one
    for i in (2, 1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = np.uint64(2)
    while q != np.uint64(1 << bits):
        p = q - one
        for i in (2, 1, 0):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q <<= one
    return x


def hilbert_code(x, y, z, bits: int = 16):
    """Hilbert indices of NumPy cell arrays."""
    import numpy as np

    axes = _hilbert_axes([np.asarray(a).astype(np.uint64) for a in (x, y, z)], bits)
    code = np.zeros(len(axes[0]), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            code = (code << np.uint64(1)) | ((a >> np.uint64(b)) & np.uint64(1))
    return code.astype(np.int64)


def hilbert_cell(code, bits: int = 16):
    """Cells of Hilbert indices."""
    import numpy as np

    code = np.asarray(code).astype(np.uint64)
    axes = [np.zeros(len(code), np.uint64) for _ in range(3)]
    for b in range(bits):
        for i in range(3):
            axes[i] |= ((code >> np.uint64(3 * b + 2 - i)) & np.uint64(1)) << np.uint64(b)
    return [a.astype(np.int64) for a in _hilbert_cells(axes, bits)]


def hilbert(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    @F.pandas_udf("long")
    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_code(a, b, c, bits))

    return code(x, y, z)


def unhilbert(code: Column, bits: int = 16) -> Column:
    @F.pandas_udf("gx long, gy long, gz long")
    def cell(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("gx", "gy", "gz"), hilbert_cell(c, bits))))

    return cell(code)


def encode(df: DataFrame, order: str = "z", bits: int = 16) -> DataFrame:
    """With ``code``: the place of the cell on the curve, x and y exchanged in the ``-trans`` orders.  A cell below 0 or beyond ``bits`` is an error."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    x, y, z = F.col("gx"), F.col("gy"), F.col("gz")
    if not 0 < bits <= MAX_BITS:
        raise ValueError(f"bits must be from 1 to {MAX_BITS}")
    wide = F.shiftright(x.bitwiseOR(y).bitwiseOR(z), bits) != 0  # negative cells too
    x = F.when(wide, F.raise_error(F.lit(f"a cell needs more than {bits} bits")).cast("long")).otherwise(x)
    if order.endswith("-trans"):
        x, y = y, x
    return df.withColumn("code", morton(x, y, z) if order.startswith("z") else hilbert(x, y, z, bits))


def decode(df: DataFrame, order: str = "z", bits: int = 16) -> DataFrame:
    """Cells from ``code``."""
    x, y, z = unmorton(F.col("code")) if order.startswith("z") else (lambda c: (c["gx"], c["gy"], c["gz"]))(unhilbert(F.col("code"), bits))
    if order.endswith("-trans"):
        x, y = y, x
    return df.withColumns({"gx": x, "gy": y, "gz": z})


def drawn_orders(orders, salt: str) -> list[str]:
    """The orders permuted by draws that the salt alone decides."""
    from hashlib import md5

    return sorted(orders, key=lambda o: md5(f"{salt}:{o}".encode()).hexdigest())


def serialize(df: DataFrame, orders=("z",), bits: int = 16, shuffle: str | None = None, most: int | None = None) -> DataFrame:
    """For each curve ``code_i``, and ``rank_i``, the place in the scene's order; ``shuffle``, a salt, permutes the curves first.

    Points of one cell and ``point_idx`` come in the same order on all curves.
    """
    out = df
    for i, order in enumerate(drawn_orders(orders, shuffle) if shuffle is not None else orders):
        tie = ("point_idx", "rank_0") if i else ("point_idx",)
        out = rank_within(encode(out, order, bits), ["scene"], "code", *tie, rank=f"rank_{i}", most=most).withColumnRenamed("code", f"code_{i}")
    return out


def patches(ranked: DataFrame, size: int, rank: str = "rank_0") -> DataFrame:
    """(scene, point_idx, patch, slot, borrowed): runs of ``size`` points along the curve.

    The last patch of a scene with more than ``size`` points is filled up with the points one
    patch before its missing places; a smaller scene is one patch as it is.
    """
    sizes = ranked.groupBy("scene").agg(F.count("*").alias("n"))
    r = ranked.select("scene", "point_idx", F.col(rank).alias("k")).join(sizes, "scene")
    own = r.select("scene", "point_idx", F.floor(F.col("k") / size).cast("long").alias("patch"), (F.col("k") % size).alias("slot"), F.lit(False).alias("borrowed"))
    # Missing places n..ceil(n/size)*size-1 take the points at those places less one patch.
    borrow = r.where((F.col("n") > size) & (F.col("n") % size != 0) & (F.col("k") + size >= F.col("n")) & (F.col("k") + size < F.ceil(F.col("n") / size) * size))
    extra = borrow.select("scene", "point_idx", F.floor((F.col("k") + size) / size).cast("long").alias("patch"), ((F.col("k") + size) % size).alias("slot"), F.lit(True).alias("borrowed"))
    return own.unionByName(extra)


def batched(code: Column, scene: Column, depth: int) -> Column:
    """One key over all scenes: the scene above the 3 x depth bits of the code.  Both must fit 63 bits."""
    if not 0 < depth <= 16:
        raise ValueError("depth must be from 1 to 16")
    return F.shiftleft(scene.cast("long"), 3 * depth).bitwiseOR(code)
