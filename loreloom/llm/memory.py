"""Memory of Python workers: what a task frees goes back to the system, as an executor keeps several workers for later tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark import TaskContext

#: glibc's number of the option, and the size from which blocks are mapped on their own and unmapped when freed.
M_MMAP_THRESHOLD, MAPPED = -3, 1 << 20

_done = False
_task: int | None = None


def frugal() -> None:
    """Called in a task before it takes much: Arrow uses the system's allocator, which gives large blocks back at once.

    What the worker's last task held to its end, such as its caches, is free only now, and is given back first. A collection takes
    tens of milliseconds, so a task that calls this for each of its groups does it once.
    """
    global _done, _task
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task is not None and task == _task:
        return
    _task = task
    gc.collect()
    trim()
    if _done:
        return
    _done = True
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, MAPPED)
    except (OSError, AttributeError):  # another C library
        pass


def trim() -> None:
    """Give back what the allocator still holds, at the end of a task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
