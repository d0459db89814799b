"""Memory of Python workers, which Spark reuses from one operator to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: str | None = None
_caches: list[Callable[[], object]] = []


def cache(clear: Callable[[], object]) -> None:
    """Registers what empties a module's cache."""
    _caches.append(clear)


def claim(owner: str) -> None:
    """Called as an operator's task starts: what other operators have left in this worker goes back to the system."""
    global _owner
    if _owner == owner:
        return
    _owner = owner
    for clear in _caches:
        clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that is free in this worker back to the system; called as a task ends, since the worker stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
