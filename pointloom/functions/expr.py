"""Column expressions that the operators share; all stay inside Spark's code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["scene", "point_idx"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded half up in binary arithmetic, which any SQL engine repeats bit for bit; no negative zero."""
    return F.floor(col(c) * float(10**places) + 0.5) / F.lit(float(10**places)) + F.lit(0.0)


def draw(salt: str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the salt and the keys alone, not on partitions."""
    text = F.concat_ws(":", F.lit(salt), *(col(k).cast("string") for k in keys or KEY))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(salt: str, *keys: Column | str) -> Column:
    """A standard normal number from two draws (Box-Muller)."""
    u1 = (draw(salt + "/a", *keys) * 4294967296.0 + 1) / 4294967297.0
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * draw(salt + "/b", *keys))


def uniform(salt: str, lo: float, hi: float, *keys: Column | str) -> Column:
    return F.lit(float(lo)) + F.lit(float(hi - lo)) * draw(salt, *keys)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def dist2(ax: str, ay: str, az: str, bx: str, by: str, bz: str) -> Column:
    dx, dy, dz = (col(a) - col(b) for a, b in ((ax, bx), (ay, by), (az, bz)))
    return dx * dx + dy * dy + dz * dz


def cell(c: Column | str, size: float) -> Column:
    """The grid cell of a coordinate."""
    return F.floor(col(c) / F.lit(float(size))).cast("long")


def lookup(c: Column, table: dict, default=None) -> Column:
    """A dictionary as an expression: no join for small fixed tables."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    got = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None)
    return got if default is None else F.coalesce(got, F.lit(default))


def add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue and saturation in [0, 1], value as given."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, F.lit(0.0)).when(hi == r, (g - b) / d).when(hi == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    return h - F.floor(h), F.when(hi == 0, F.lit(0.0)).otherwise(d / hi), hi


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    six = (h - F.floor(h)) * 6.0
    i = F.floor(six)
    f = six - i
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))

    def pick(*by_sextant: Column) -> Column:
        out = by_sextant[5]
        for k in range(4, -1, -1):
            out = F.when(i == k, by_sextant[k]).otherwise(out)
        return out

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The rotation of a unit quaternion, row by row."""
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
        [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
        [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)],
    ]


def spread_bits(c: Column) -> Column:
    """Bits 0..15 of an integer at every third place."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask))
    return c


def compact_bits(c: Column) -> Column:
    """The inverse of :func:`spread_bits`."""
    c = c.bitwiseAND(F.lit(0x249249249249))
    for shift, mask in ((2, 0x0C30C30C30C3), (4, 0x00F00F00F00F), (8, 0x0000FF0000FF), (16, 0x00000000FFFF)):
        c = c.bitwiseOR(F.shiftrightunsigned(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    """The Z-order code of cells of up to 16 bits: bit i of x, y, z goes to bit 3i+2, 3i+1, 3i."""
    sx, sy, sz = (spread_bits(c.cast("long")) for c in (x, y, z))
    return F.shiftleft(sx, 2).bitwiseOR(F.shiftleft(sy, 1)).bitwiseOR(sz)


def unmorton(code: Column) -> tuple[Column, Column, Column]:
    return tuple(compact_bits(F.shiftrightunsigned(code, k)) for k in (2, 1, 0))


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """a x b of quaternions w, x, y, z."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def quaternion_inverse(q: list[Column]) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def quaternion_rotate(q: list[Column], v: list[Column]) -> list[Column]:
    return [m[0] * v[0] + m[1] * v[1] + m[2] * v[2] for m in quaternion_matrix(*q)]


def to_gray(c: Column) -> Column:
    return c.bitwiseXOR(F.shiftrightunsigned(c, 1))


def from_gray(c: Column, bits: int = 64) -> Column:
    """The inverse of :func:`to_gray`: a prefix xor by doubled shifts."""
    s = 1
    while s < bits:
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
        s *= 2
    return c
