"""Golomb codes (divisor a power of two) of sorted distinct integers, in numpy."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<IBI")


def encode(values: np.ndarray, base: int) -> bytes:
    """Sorted distinct ``values`` >= ``base`` as coded gaps.

    The divisor is the power of two below 0.69 of the mean gap.  Remainders
    are packed at fixed width, quotients follow in unary.
    """
    n = len(values)
    if not n:
        return HEADER.pack(0, 0, 0)
    gaps = np.diff(values, prepend=np.uint64(base)).astype(np.uint64)
    mean = int(values[-1] - np.uint64(base)) / n
    k = max(0, int(np.floor(np.log2(max(1.0, 0.69 * mean)))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    low = b""
    if k:
        bits = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel()).tobytes()
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return HEADER.pack(n, k, len(low)) + low + np.packbits(unary).tobytes()


def decode(blob: bytes, base: int) -> np.ndarray:
    n, k, size = HEADER.unpack_from(blob)
    if not n:
        return np.zeros(0, np.uint64)
    low = np.zeros(n, np.uint64)
    at = HEADER.size
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, size, at))[: n * k].reshape(n, k)
        for j in range(k):
            low = (low << np.uint64(1)) | bits[:, j].astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + size)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) | low) + np.uint64(base)
