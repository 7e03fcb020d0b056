"""Python workers' memory."""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: glibc's way to give freed memory back; other libraries have none or need none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give what this process has freed back to the system: its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
