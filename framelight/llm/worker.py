"""What a Python worker keeps while Spark reuses it.

Workers outlive stages.  Tables that one operator keeps between batches are dropped when a batch of
another operator arrives, and freed memory goes back to the system, so that an executor never holds
the tables of several operators at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: glibc's M_MMAP_THRESHOLD (blocks from this size on return to the system when they are freed) and M_ARENA_MAX.
_SETTINGS = {-3: 1 << 20, -8: 1}

_held: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def _libc(name: str):
    try:
        return getattr(ctypes.CDLL(None), name)
    except AttributeError:  # another C library
        return lambda *_: 0


def trim() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim")(0)


def enter(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Starts a batch of ``owner``, whose tables ``clear`` drops; the tables of other owners go."""
    if _last != [owner]:
        if not _last:
            for name, value in _SETTINGS.items():
                _libc("mallopt")(name, value)
            pa.set_memory_pool(pa.system_memory_pool())  # the other pools keep what is freed
        for other in [x for x in _held if x != owner]:
            _held.pop(other)()
        _last[:] = [owner]
        trim()
    if clear:
        _held[owner] = clear


def leave() -> None:
    """Ends a stream of batches: a worker that waits for work holds no tables."""
    for other in list(_held):
        _held.pop(other)()
    _last[:] = [""]
    trim()
