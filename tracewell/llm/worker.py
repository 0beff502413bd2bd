"""What a Python worker keeps between tasks, and when it lets go of it.

Spark hands a worker from one operator's tasks to the next one's. Caches of hashes or token ids serve the operator
that filled them and are memory lost to the others, so a task first tells whose turn it is.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa

_DROPS: dict[str, Callable[[], None]] = {}
_LAST = [""]


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Names how the owner's caches of this process are emptied."""
    _DROPS[owner] = drop


def turn(owner: str) -> None:
    """Called as a task begins: if another owner's task ran before, the caches of all others go and freed memory returns to the system."""
    if _LAST[0] == owner:
        return
    _LAST[0] = owner
    for name, drop in _DROPS.items():
        if name != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what is freed for later
            pass
