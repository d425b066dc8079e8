"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes
import gc


def release() -> None:
    """Give back what a finished task has freed: Arrow's pool and the C heap keep it otherwise, task after task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
