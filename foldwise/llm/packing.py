"""Arrays of whole numbers as compressed bytes.

The lowest bytes of all numbers stand together, then the second lowest, and so
on: in high bytes, which are alike, the compressor finds what to save.
"""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def pack(values: np.ndarray) -> bytes:
    """Numbers that are not negative, in as many bytes each as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=_LEVEL).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8)
    planes = planes.reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
