"""Counts in one byte each, mostly."""

from __future__ import annotations

import numpy as np


def small_ints(values: np.ndarray) -> bytes:
    """One byte each, larger ones apart at the end."""
    return np.uint32(len(values)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def ints(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    out = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=4 + n)
    return out
