"""Arrays and byte strings packed into one compressed value, so that a shuffle moves few, dense rows."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = {"u8": np.uint64, "i8": np.int64, "i4": np.int32, "u2": np.uint16, "b1": np.uint8}
_CODES = {np.dtype(t): c.encode() for c, t in _KINDS.items()}


def pack_arrays(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    parts = []
    for a in arrays:
        a = np.frombuffer(a, np.uint8) if isinstance(a, bytes) else np.ascontiguousarray(a)
        raw = a.tobytes()
        parts.append(struct.pack("<2sq", _CODES[a.dtype], len(raw)) + raw)
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        code, size = struct.unpack_from("<2sq", raw, at)
        at += 10
        out.append(np.frombuffer(raw, _KINDS[code.decode()], size // np.dtype(_KINDS[code.decode()]).itemsize, at))
        at += size
    return out
