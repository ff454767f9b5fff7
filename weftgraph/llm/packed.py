"""Arrays of whole numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", 1)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, in the fewest bytes that hold them."""
    x = np.ascontiguousarray(x)
    if len(x) and x.dtype != bool:
        x = x.astype(np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return x.dtype.str.encode().ljust(4) + len(x).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype(bytes(data[:4]).decode().strip()), int.from_bytes(data[4:12], "little")
    planes = _ZSTD.decompress(data[12:], n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
