"""What a Python worker keeps between batches and tasks.

Workers are reused: what one operator keeps in a module outlives its stage. So
all memos of a worker are kept here, for one operator at a time: when another
operator asks for its state, that of the one before is dropped and the memory
goes back to the system. Each memo has a bound of its own.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_OWNER: list[str] = [""]
_HELD: dict[Hashable, Any] = {}


def state(owner: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's ``key`` of the operator ``owner``, made when first asked for."""
    if _OWNER[0] != owner:
        _HELD.clear()
        _OWNER[0] = owner
        give_back()
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory to the system, as far as the platform can."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
