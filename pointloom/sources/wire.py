"""The wire format of nested messages: numbered fields, each a number or a run of bytes."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

VARINT, EIGHT, BYTES, FOUR = 0, 1, 2, 5


def _varint(buf: memoryview, p: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if p >= len(buf) or shift > 63:
            raise ValueError("a number breaks off")
        b = buf[p]
        p += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, p
        shift += 7


def fields(buf) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field number, kind, value) in order: a number for :data:`VARINT`, else the bytes."""
    buf, p = memoryview(buf).cast("B"), 0
    while p < len(buf):
        tag, p = _varint(buf, p)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, p = _varint(buf, p)
        else:
            if kind == BYTES:
                n, p = _varint(buf, p)
            elif kind in (EIGHT, FOUR):
                n = 8 if kind == EIGHT else 4
            else:
                raise ValueError(f"field {number} is of an unknown kind {kind}")
            if p + n > len(buf):
                raise ValueError(f"field {number} breaks off")
            value, p = buf[p : p + n], p + n
        yield number, kind, value


def message(buf) -> dict[int, list]:
    """All values of each field number."""
    out = defaultdict(list)
    for number, _, value in fields(buf):
        out[number].append(value)
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def floats(values: Iterable, dtype: str) -> np.ndarray:
    """Repeated fixed-width numbers, one by one or packed, as one array."""
    return np.frombuffer(b"".join(bytes(v) for v in values), dtype)


def varints(values: Iterable) -> np.ndarray:
    """Repeated whole numbers, one by one or packed."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(signed(v))
            continue
        raw = np.frombuffer(v, np.uint8)
        if not (raw & 128).any():  # small numbers, as in most label images
            out += raw.tolist()
            continue
        p = 0
        while p < len(v):
            n, p = _varint(v, p)
            out.append(signed(n))
    return np.array(out, np.int64)


def number(value: int) -> bytes:
    out, value = bytearray(), value & 0xFFFFFFFFFFFFFFFF
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def put(field: int, value: int | float | bytes | str) -> bytes:
    """One field: whole numbers as varints, floats in eight bytes, texts and messages as bytes."""
    if isinstance(value, int):
        return number(field << 3 | VARINT) + number(value)
    if isinstance(value, float):
        return number(field << 3 | EIGHT) + struct.pack("<d", value)
    value = value.encode() if isinstance(value, str) else bytes(value)
    return number(field << 3 | BYTES) + number(len(value)) + value


def put_float(field: int, value: float) -> bytes:
    """One field of four bytes."""
    return number(field << 3 | FOUR) + struct.pack("<f", value)
