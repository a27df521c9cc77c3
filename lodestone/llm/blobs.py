"""Number columns as compressed byte planes: a few bytes a row through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*columns: np.ndarray, delta: int = 0) -> bytes:
    """All columns, each as zstandard-compressed byte planes; the first ``delta`` columns ascend and are kept as differences."""
    out = []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        if i < delta and len(c):
            c = np.concatenate([c[:1], np.diff(c)])
        planes = c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T if len(c) else np.empty((0, 0), np.uint8)
        body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        head = np.array([len(c), len(body), i < delta], np.int64).tobytes() + c.dtype.str.encode().ljust(8)
        out += [head, body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, size, delta = np.frombuffer(blob, np.int64, 3, at).tolist()
        kind = np.dtype(blob[at + 24 : at + 32].strip().decode())
        data = zstandard.ZstdDecompressor().decompress(blob[at + 32 : at + 32 + size], max_output_size=max(1, n * kind.itemsize))
        c = np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.empty(0, kind)
        out.append(np.cumsum(c, dtype=kind) if delta else c)
        at += 32 + size
    return out
