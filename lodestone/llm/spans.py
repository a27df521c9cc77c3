"""Ranges to remove from documents, on their way from where they are found to the texts.

A range names its document by id and a 16-bit tag of the text.  Finders send ranges in
rows of (bucket, blob), one for each bucket of documents that they have something
for; a bucket's task merges them into one row a document, and those join the texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blobs import packed, unpacked
from .text import U64, mix

LAST = (1 << 63) - 1  # stands for a null id, after all others
BUCKET_BYTES = 8 << 20  # text whose ranges are merged together
KEY = "doc long, tag int, blob binary"


def n_buckets(n_bytes: int) -> int:
    return 1 + n_bytes // BUCKET_BYTES


def tag_of(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFF


def rows(doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """(buckets, blobs) of the ranges."""
    bucket = (mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + tag.astype(U64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((low, tag, doc, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    columns = [doc.astype(np.int64)[order], tag.astype(np.uint16)[order], low.astype(np.int32)[order], high.astype(np.int32)[order]]
    return bucket[cuts].tolist(), [packed(*(c[a:b] for c in columns)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=False)]


def by_document(found: DataFrame) -> DataFrame:
    """doc, tag, blob (ascending, separate ranges) from rows of (bucket, blob)."""

    def merge(key, group):
        doc, tag, low, high = (np.concatenate(x) for x in zip(*(unpacked(b) for b in group.column("blob").to_pylist()), strict=True))
        order = np.lexsort((low, tag, doc))
        doc, tag, low, high = doc[order], tag[order], low[order].astype(np.int64), high[order].astype(np.int64)
        new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        number = np.cumsum(new_doc) << 33  # so that no range reaches the next document
        reach = np.maximum.accumulate(number + high)
        new = np.concatenate([[True], number[1:] + low[1:] > reach[:-1]])
        first = np.flatnonzero(new)
        low, high = low[first], (reach - number)[np.append(first[1:], len(doc)) - 1]
        cuts = np.flatnonzero(new_doc[first])
        ends = np.append(cuts[1:], len(first)).tolist()
        blobs = [packed(low[a:b], high[a:b]) for a, b in zip(cuts.tolist(), ends, strict=True)]
        return pa.table({"doc": pa.array(doc[first[cuts]], pa.int64()), "tag": pa.array(tag[first[cuts]], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return found.groupBy("bucket").applyInArrow(merge, KEY)


def with_ranges(docs: DataFrame, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` and text of the documents with the blob of their ranges (null: none) as _gone; ``docs`` has doc_id, text."""
    tag = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).bitwiseAND(F.lit(0xFFFF)).cast("int")
    names = [c for c in dict.fromkeys([*columns, "text"])]
    own = docs.select(*names, F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), tag.alias("_tag"))
    return own.join(by_document(found).toDF("_doc", "_tag", "_gone"), ["_doc", "_tag"], "left").select(*names, "_gone")
