"""Word tables of Arrow batches, computed with numpy instead of per-word Python.

A batch is cut into chunks of about ``CHUNK`` bytes of text (one row at least),
so a worker's memory follows the longest text and not the batch.  Words are
byte ranges of the UTF-8 text; their 64-bit hashes come from one running sum.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64

# Workers live long and share an executor's memory with its JVM: what is freed goes back at once.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):  # not glibc
    ctypes.CDLL(None).mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    ctypes.CDLL(None).mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD: chunks reuse their memory


CACHES: list[Callable[[], None]] = []  # clear what a worker keeps from task to task


def trim(keep: Callable[[], None] | None = None) -> None:
    """Give back what was freed in between as well, and the caches but ``keep``, so that a worker does not go on with what earlier tasks left."""
    for clear in CACHES:
        if clear != keep:
            clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_R, _S = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_pow: dict[int, np.ndarray] = {}
CACHES.append(_pow.clear)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)  # all but 0-9, a-z and bytes of non-ASCII characters
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1); kept for usual chunks only."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK + 2), base, U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) == CHUNK + 2:
            _pow[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """H with H[j] - H[i] = base**i * hash(data[i:j]), modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start] + (end - start).astype(U64))


class Chunk:
    """Rows of a batch with the raw bytes of their texts; a null text is empty."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.data, self.offsets = batch, data, offsets
        self.n = batch.num_rows

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Byte ranges of a chunk's words; ``first[d]`` is the first word of row d."""

    def __init__(self, chunk: Chunk, gaps: np.ndarray = WHITE, lower: bool = True):
        self.data = LOWER[chunk.data] if lower else chunk.data
        n = len(self.data)
        inside = ~gaps[self.data]
        edge = np.zeros(n + 1, bool)  # rows begin here, so no word passes
        edge[chunk.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        here = np.zeros(n + 1, bool)
        here[:-1] = inside
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, chunk.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(chunk.n), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data, _R), self.start, self.end, _R)

    def windows(self, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window of k words that stays in its row, its mixed hash)."""
        at = np.flatnonzero(np.arange(len(word)) + k <= self.first[1:][self.doc])
        return at, mix(rolling(word, k, _S)[at]) if len(at) else np.empty(0, U64)


def rolling(word: np.ndarray, k: int, base: int) -> np.ndarray:
    """sum(word[i + j] * base**(k - 1 - j)) for each i with k words from there; 0 for the rest."""
    out = np.zeros(len(word), U64)
    if len(word) >= k:
        total = np.zeros(len(word) - k + 1, U64)
        for j in range(k):
            total = total * U64(base) + word[j : len(word) - k + 1 + j]
        out[: len(total)] = total
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", cap: int = CHUNK) -> Iterator[Chunk]:
    trim(_pow.clear)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        col = col.cast(pa.large_binary())
        if not len(col):
            continue
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.empty(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + cap, side="right")) - 1)
            yield Chunk(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
    trim(_pow.clear)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def carried_columns(keep: tuple[str, ...], made: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to carry along; what an operator makes itself takes the place of a column of that name."""
    return tuple(c for c in dict.fromkeys(keep) if c not in made)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
