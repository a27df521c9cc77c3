"""A corpus as blocks of numbered words, written once: what several passes need without parsing again.

A block has about ``BLOCK`` words (a longer text is one block): per row its id, whether the
id is null, a 16-bit tag of the text and its number of words; a dictionary of word
hashes; and the words as numbers into it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blobs import packed, unpacked
from .spans import LAST, tag_of
from ..plans.lineage import table
from .text import Words, chunks

BLOCK = 1 << 19
PAYLOAD = ("rows", "words", "tokens")


def blocks(documents: DataFrame, lower: bool, size: int = BLOCK) -> DataFrame:
    """block, n_words and the columns of PAYLOAD, in the shared folder; ``documents`` has doc_id, text."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            ids, null, tag, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            dictionary, token = np.unique(h, return_inverse=True)
            blobs = packed(ids, null, tag, n), packed(dictionary, delta=1), packed(token.astype(np.uint32))
            arrays = [pa.array([uuid.uuid4().hex]), pa.array([len(h)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "n_words", *PAYLOAD])

        for chunk in chunks(batches):
            words = Words(chunk, lower=lower)
            ids = chunk.batch.column(0)
            tags = np.array([tag_of(chunk.bytes_of(i)) for i in range(chunk.n)], np.uint16)
            held.append((ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), tags, words.count.astype(np.int32), words.hashes()))
            if sum(len(x[4]) for x in held) >= size:
                yield flush()
        if held:
            yield flush()

    schema = "block string, n_words long, rows binary, words binary, tokens binary"
    return table(documents.select("doc_id", "text").mapInArrow(run, schema), "blocks")


class Block:
    """ids, null, tag, count of the rows; doc and first as in ``text.Words``; word: the words' hashes."""

    def __init__(self, rows: bytes, words: bytes, tokens: bytes):
        self.ids, self.null, self.tag, self.count = unpacked(rows)
        self.word = unpacked(words)[0][unpacked(tokens)[0]]
        self.first = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def whole_windows(self, k: int) -> np.ndarray:
        """First words of the windows of k words that stay in their row."""
        return np.flatnonzero(np.arange(len(self.word)) + k <= self.first[1:][self.doc])
