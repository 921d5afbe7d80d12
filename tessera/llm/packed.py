"""Arrays of numbers as compressed bytes: byte planes, and differences for sorted arrays."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<BBBI")
_KINDS = [np.dtype(np.int64), np.dtype(np.uint64), np.dtype(np.float64)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other. Whole numbers from 0 up take as few bytes each as the largest needs; ascending ones are kept as differences."""
    heads, planes = [], []
    for a in arrays:
        kind = 2 if a.dtype.kind == "f" else a.dtype == np.uint64
        b, rising = np.ascontiguousarray(a, _KINDS[kind]), False
        if kind < 2 and len(b):
            rising = len(b) > 1 and bool((b[1:] >= b[:-1]).all())
            if rising:
                b = np.diff(b, prepend=b.dtype.type(0))
            b = b.astype(np.min_scalar_type(int(b.max())))
        heads.append(_HEAD.pack(kind, b.itemsize, rising, len(b)))
        planes.append(b.view(np.uint8).reshape(len(b), b.itemsize).T.tobytes())
    body = b"".join(planes)
    return struct.pack("<HQ", len(arrays), len(body)) + b"".join(heads) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of pack(): 64-bit whole numbers (unsigned where they were) and floating-point ones."""
    n, size = struct.unpack_from("<HQ", data)
    start = 10 + n * _HEAD.size
    body = zstandard.ZstdDecompressor().decompress(data[start:], max_output_size=max(1, size)) if size else b""
    out, at = [], 0
    for i in range(n):
        kind, width, rising, length = _HEAD.unpack_from(data, 10 + i * _HEAD.size)
        planes = np.frombuffer(body, np.uint8, length * width, at) if length else np.empty(0, np.uint8)
        at += length * width
        flat = np.ascontiguousarray(planes.reshape(width, length).T).reshape(-1)
        a = flat.view(np.float64 if kind == 2 else f"<u{width}").astype(_KINDS[kind], copy=False)
        out.append(np.cumsum(a, dtype=_KINDS[kind]) if rising else a)
    return out


def steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of rows in ascending order, each as differences within equal values of those before it (the first as it is)."""
    out, same = columns[:1], np.ones(max(0, len(columns[0]) - 1), bool)
    for before, own in zip(columns, columns[1:]):
        same = same & (before[1:] == before[:-1])
        step = own.copy()
        step[1:] -= np.where(same, own[:-1], 0)
        out.append(step)
    return out


def unsteps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of steps()."""
    out, n = columns[:1], len(columns[0])
    same = np.ones(max(0, n - 1), bool)
    for step in columns[1:]:
        same = same & (out[-1][1:] == out[-1][:-1])
        first = np.flatnonzero(np.append(True, ~same)[:n])
        total = np.cumsum(step)
        out.append(total - np.repeat(total[first] - step[first], np.diff(np.append(first, n))))
    return out
