"""Python workers that hand memory back.

A worker outlives its task and keeps what its allocators hold, so the few workers of an executor add up over a job of many stages.
"""

from __future__ import annotations

import ctypes
import inspect

import pyarrow as pa


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lean(f):
    """f, over Arrow batches (a generator) or over the table of one group, whose worker releases memory at its end."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                release()

    else:

        def run(table):
            try:
                return f(table)
            finally:
                release()

    return run
