"""Substring dedup: windows of words that an earlier document has, behind a count-min prefilter.

1. Texts become blocks of numbered words, written once (``wordblocks``).
2. Each block sketches its windows: the numbers of their cells, in order, as compressed
   differences, cut into ranges of cells.  A range's task merges the blocks' sketches
   and tells each block which of its cells were counted twice or more (``tally``).
   Counts are never underestimated, so no repeated window is lost; the sketch grows
   with the corpus, is never in one place, and nothing is broadcast.
3. A second pass takes the windows all of whose cells have that mark and groups them
   exactly, by 96-bit hashes of their word sequences.  A block settles what it can
   by itself: of equal windows only those of its smallest document go on, so a
   window that all documents share costs a block one entry.
4. Places to remove meet the texts by document.

Words are runs of other bytes than ASCII white space, unchanged.  A null or empty
text has no words.  Rows with the same id are one rank: they take nothing from
each other, and null ids rank last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.lineage import release, table
from .blobs import packed, unpacked
from .spans import n_buckets, rows, with_ranges
from .tally import Cells, Classes, counted
from .text import Words, carried_columns, chunks, covered, mix, rolling
from .wordblocks import PAYLOAD, Block, blocks

WINDOW = 13
#: Of the count-min sketch: hash functions, and cells a window for each.  As its width has no limit, one wide
#: row overestimates less than two narrow ones do for the same bytes.
ROWS, SPARSE = 1, 8
BLOCK = 1 << 20
ENTRIES = 1 << 20  # windows that are grouped together
_S, _Q = 0xD1342543DE82EF95 | 1, 0xAF251AF3B0F025B5 | 1


def window_hashes(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, 64-bit hash) of each window."""
    at = b.whole_windows(k)
    return at, mix(rolling(b.word, k, _S)[at])


def settled(h, h2, doc, tag, at):
    """Sorted entries, and which of them an equal window of a smaller document rules out."""
    order = np.lexsort((at, tag, doc, h2, h))
    h, h2, doc, tag, at = (x[order] for x in (h, h2, doc, tag, at))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    least = doc[new][np.cumsum(new) - 1] if len(h) else doc
    return (h, h2, doc, tag, at), doc > least


def removals(docs: DataFrame, k: int = WINDOW, block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """Rows of (bucket, blob): ranges of words to remove."""
    own = blocks(docs, lower=False, size=block)
    n_words = own.agg(F.sum("n_words")).first()[0] or 0
    cells = Cells(n_words, ROWS, SPARSE, entries)
    told = counted(own.select("block", *PAYLOAD), lambda *payload: window_hashes(Block(*payload), k)[1], cells)
    buckets = n_buckets(6 * n_words)
    segments = 1 << (n_words // entries).bit_length()
    shift = np.uint64(64 - segments.bit_length() + 1)

    def candidates(key, left, right):
        b = Block(*(left.column(c)[0].as_py() for c in PAYLOAD))
        at, h = window_hashes(b, k)
        again = Classes(right, cells).of(h) > 0
        at, h = at[again], h[again]
        h2 = (mix(rolling(b.word, k, _Q)[at]) >> np.uint64(32)).astype(np.uint32)
        d = b.doc[at]
        entry, gone = settled(h, h2, b.ids[d], b.tag[d], (at - b.first[d]).astype(np.int32))
        number, blob = rows(entry[2][gone], entry[3][gone], entry[4][gone], entry[4][gone] + k, buckets)
        number = [segments + x for x in number]
        h, h2, d, t, at = (x[~gone] for x in entry)
        where = (h >> shift).astype(np.int64) if segments > 1 else np.zeros(len(h), np.int64)
        cuts = np.searchsorted(where, np.arange(segments + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part = np.arange(cuts[s], cuts[s + 1])
            part = part[np.lexsort((at[part], t[part], d[part]))]  # by document: its columns hardly take room then
            number.append(s)
            blob.append(packed(d[part], t[part], np.diff(at[part], prepend=0).astype(np.int32), h[part], h2[part], delta=1))
        return pa.table({"key": pa.array(number, pa.int64()), "blob": pa.array(blob, pa.binary())})

    def group(key, found):
        number, blobs = key[0].as_py(), found.column("blob").to_pylist()
        if number >= segments:  # settled by a block already
            return pa.table({"bucket": pa.array([number - segments] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})
        d, t, step, h, h2 = zip(*(unpacked(b) for b in blobs), strict=True)
        at = [np.cumsum(x, dtype=np.int32) for x in step]
        entry, gone = settled(*map(np.concatenate, (h, h2, d, t, at)))
        bucket, blob = rows(entry[2][gone], entry[3][gone], entry[4][gone], entry[4][gone] + k, buckets)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blob, pa.binary())})

    out = own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(candidates, "key long, blob binary")
    return out.groupBy("key").applyInArrow(group, "bucket long, blob binary")


def dedup(documents: DataFrame, k: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep``, n_words, n_removed, kept_sha256 (with_text: and kept_text, words joined by a space); these replace columns of their names."""
    keep = carried_columns(keep, ("n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text))
    docs = documents.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    found = table(removals(docs.select("doc_id", "text"), k), "ranges")
    release(docs.sparkSession)  # the windows' shuffles end here
    both = with_ranges(docs, found, keep)

    def run(batches):
        for chunk in chunks(batches):
            words = Words(chunk, lower=False)
            gone = chunk.batch.column(chunk.batch.schema.get_field_index("_gone")).to_pylist()
            removed, sha, texts = [], [], []
            for d in range(chunk.n):
                tokens = chunk.bytes_of(d).split()
                n = len(tokens)
                if gone[d]:
                    mask = covered(n, *unpacked(gone[d]))
                    tokens = [w for w, g in zip(tokens, mask.tolist(), strict=True) if not g]
                left = b" ".join(tokens)
                removed.append(n - len(tokens))
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if with_text else None)
            own = [chunk.batch.column(chunk.batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), *[pa.array(texts, pa.string())] * with_text], names=[*keep, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    schema = T.StructType([documents.schema[c] for c in keep]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return both.mapInArrow(run, schema.add("kept_text", "string") if with_text else schema)
