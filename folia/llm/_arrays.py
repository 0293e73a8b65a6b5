"""Arrays of numbers as small blobs."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard


def narrow(n: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in the smallest unsigned type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max()))) if len(n) else n.astype(np.uint8)


def planes(x: np.ndarray) -> bytes:
    """An array byte by byte of all its numbers, so that it compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def flat(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob; an array of 64-bit numbers in order should come as differences."""
    arrays = [narrow(x) for x in arrays]
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, arrays)))
    return pickle.dumps(([(len(x), x.dtype.str) for x in arrays], data), protocol=5)


def unpacked(blob: bytes) -> list[np.ndarray]:
    shapes, data = pickle.loads(blob)
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for n, kind in shapes:
        size = n * np.dtype(kind).itemsize
        out.append(flat(data[at : at + size], kind))
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of numbers in order; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def groups(*columns: np.ndarray) -> np.ndarray:
    """The places where neighbouring rows differ, 0 first."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
