"""Numpy arrays as compact bytes, for shuffles of very many small numbers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<2sQQ")


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first to 0; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, each by its bytes of equal place, compressed."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        data = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        parts += [_HEAD.pack(a.dtype.str[1:].encode(), len(a), len(data)), data]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        dtype = np.dtype(kind.decode())
        if n:
            planes = pa.decompress(data[at : at + size], n * dtype.itemsize, codec="zstd", asbytes=True)
            flat = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T
            out.append(np.ascontiguousarray(flat).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out
