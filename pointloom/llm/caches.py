"""Tables that a worker keeps from task to task.  An operator that starts empties those of the others."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_CLEAR: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def claim(*names: str) -> None:
    """Keep only the tables of these names."""
    for name, clear in _CLEAR.items():
        if name not in names:
            clear()


def give_back() -> None:
    """Return memory that a task has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
