"""How often each value of a corpus occurs, counted by ranges and told back to where the values are.

Values are 64-bit hashes; they are counted in the cells of a sketch that has some cells
for each value, so a count is never too low and seldom too high.  No task holds more
than one range of cells and nothing is broadcast, however large the corpus is:

1. Each block of the corpus sends its distinct cells, ascending, as compressed
   differences, cut into ranges of cells, with how often it has each.
2. A range's task adds the blocks' counts and returns to each block, for its own
   cells in their order, the class of the total: floor(log2(count)), a byte each.
3. ``Classes`` puts the ranges of one block together again.

With several rows (hash functions), the least class counts, as in a count-min sketch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blobs import packed, unpacked
from .text import U64, mix

SPARSE = 8  # cells a value
RANGE = 1 << 19  # values that are counted together
SCHEMA = "block string, row int, range long, blob binary"


class Cells:
    """The shape of a sketch for so many values: rows, bits of a cell number, bits of a range number."""

    def __init__(self, values: int, rows: int = 1, sparse: int = SPARSE, per_range: int = RANGE):
        self.rows = rows
        self.bits = max(16, (sparse * max(1, values)).bit_length())
        self.range_bits = min(self.bits - 16, max(0, (max(1, values) // per_range).bit_length()))
        self.within = self.bits - self.range_bits

    def of(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h + U64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(64 - self.bits)


def counted(blocks: DataFrame, hashes: Callable[..., np.ndarray], cells: Cells) -> DataFrame:
    """Rows of SCHEMA for Classes.  ``blocks``: block (a name) and the columns that ``hashes`` takes to give the block's values, repeated ones as often as they count."""

    def send(batches):
        for batch in batches:
            for name, *payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = hashes(*payload)
                for row in range(cells.rows):
                    c, n = np.unique(cells.of(h, row), return_counts=True)
                    n = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
                    cuts = np.searchsorted(c >> U64(cells.within), np.arange((1 << cells.range_bits) + 1, dtype=U64))
                    c &= U64((1 << cells.within) - 1)
                    parts = np.flatnonzero(np.diff(cuts)).tolist()
                    if parts:
                        blobs = [packed(c[a:b].astype(np.uint32), n[a:b], delta=1) for a, b in ((cuts[p], cuts[p + 1]) for p in parts)]
                        arrays = [pa.array([name] * len(parts)), pa.array([row] * len(parts), pa.int32()), pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["block", "row", "range", "blob"])

    def add(key, group):
        total = np.zeros(1 << cells.within, np.uint32)
        own = []
        for blob in group.column("blob"):
            c, n = unpacked(blob.as_py())
            total[c] += np.minimum(n, ~total[c])  # cells of one block differ
            own.append(c)
        classes = [packed(np.log2(total[c]).astype(np.uint8)) for c in own]
        return group.set_column(3, "blob", pa.array(classes, pa.binary()))

    return blocks.mapInArrow(send, SCHEMA).groupBy("row", "range").applyInArrow(add, SCHEMA)


class Classes:
    """What ``counted`` says about one block; ``group`` are its rows."""

    def __init__(self, group: pa.Table, cells: Cells):
        self.cells, self.rows = cells, []
        told: list[list[tuple[int, bytes]]] = [[] for _ in range(cells.rows)]
        for row, part, blob in zip(*(group.column(c).to_pylist() for c in ("row", "range", "blob")), strict=True):
            told[row].append((part, blob))
        for own in told:
            self.rows.append(np.concatenate([unpacked(b)[0] for _, b in sorted(own)]) if own else np.empty(0, np.uint8))

    def of(self, h: np.ndarray) -> np.ndarray:
        """floor(log2(count)) of each of the block's values, in the order given."""
        out = np.full(len(h), 255, np.uint8)
        for row, classes in enumerate(self.rows):
            _, at = np.unique(self.cells.of(h, row), return_inverse=True)
            out = np.minimum(out, classes[at]) if len(h) else out
        return out
