"""Suffix-array dedup: bytes of strings of ``length`` bytes that also start anywhere else.

Any such string holds an anchor, the least of the hashed ``gram``-byte strings in it (the
leftmost of equal ones), and equal strings hold it at the same place.  The strings of one
anchor begin one after the other: they are a segment, and a string is in one segment only.

1. A string shares with its copies a core of bytes around the anchor, one of ``CORES`` by
   where the anchor lies.  How often each core occurs is counted by ranges and told back
   to the blocks of the corpus (``tally``); segments without a repeated core go no further.
2. Segments go to shards by their anchor's hash, each distinct one of a block once, with the
   places that have it.  A shard does the same for its blocks' segments.
3. A shard cuts its distinct segments to the strings whose hashes more than one place has.
4. The suffixes of the distinct pieces are sorted by induction; the permuted common prefixes
   tell which neighbours share ``length`` bytes.  A run of such suffixes is one string; it
   is repeated if its pieces stand at two or more places, and then goes at all of them.
5. Ranges to remove meet the texts by document.

Texts are UTF-8 bytes; null is empty.  Strings never cross rows.  Rows with equal ids
are two places.  Matches are exact up to collisions of 64-bit hashes between the
neighbours of a sorted shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.lineage import release, table
from .blobs import packed, unpacked
from .spans import LAST, n_buckets, rows, tag_of, with_ranges
from .suffix import common_prefixes, suffix_array
from .tally import Cells, Classes, counted
from .text import U64, carried_columns, chunks, covered, mix, powers, prefix_hash, span_hash

LENGTH, GRAM, CORES = 400, 64, 4
SHARD = 1 << 20  # bytes that are sorted together
BLOCK_BYTES = 4 << 20
_R = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_R, -1, 1 << 64)


def sliding(op: np.ufunc, x: np.ndarray, w: int, fill: int) -> np.ndarray:
    """op over x[i : i + w] for each i with so many left."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).reshape(-1)
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def core_cuts(length: int, gram: int) -> list[int]:
    return [(length - gram) * j // CORES for j in range(CORES + 1)]


class Anchors:
    """at: anchors of some texts; doc, low and high: their row and segment (all strings that they lead); hash: of the anchor's bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        n, w = len(data), length - gram + 1
        self.length, self.gram = length, gram
        self.at = self.low = self.high = np.empty(0, np.int64)
        self.hash = np.empty(0, U64)
        if n >= length:
            self.prefix = prefix_hash(data, _R)
            g = mix((self.prefix[gram:] - self.prefix[:-gram]) * powers(_INVERSE, n + 1)[: n - gram + 1])
            end = np.repeat(offsets[1:], np.diff(offsets))
            bits = U64(n.bit_length())
            place = np.arange(n - gram + 1, dtype=U64)
            ranked = ((g >> bits) << bits) | place  # ties by place: the same in every copy of a string
            leader = (sliding(np.minimum, ranked, w, 0xFFFFFFFFFFFFFFFF) & U64((1 << int(bits)) - 1)).astype(np.int64)
            start = np.flatnonzero(np.arange(len(leader)) + length <= end[: len(leader)])
            own = leader[start]
            if len(start):
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
                self.at, self.low = own[new], start[new]
                self.high = start[np.append(new[1:], len(start)) - 1] + length
                self.hash = g[self.at]
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor number, hash) of the cores that their segments hold."""
        cuts = core_cuts(self.length, self.gram)
        who, out = [], []
        for j in range(CORES if len(self.at) else 0):
            low, high = self.at - cuts[j], self.at + self.length - cuts[j + 1]
            ok = np.flatnonzero((low >= self.low) & (high <= self.high))
            who.append(ok)
            out.append(span_hash(self.prefix, low[ok], high[ok], _R) + U64(j))
        return (np.concatenate(who), np.concatenate(out)) if who else (np.empty(0, np.int64), np.empty(0, U64))


def runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places, which ascend."""
    if not len(start):
        return start, start
    cut = np.flatnonzero(np.diff(start) > 1)
    return start[np.append(0, cut + 1)], start[np.append(cut, len(start) - 1)]


Place = tuple[np.ndarray, np.ndarray, np.ndarray]  # documents, tags, first bytes


class Shard:
    """Distinct segments with the places that have them."""

    def __init__(self, length: int):
        self.length = length
        self.body: list[bytes] = []
        self.anchor: list[int] = []  # the hash: only segments of one anchor have strings in common
        self.places: list[list[Place]] = []
        self.number: dict[tuple[bytes, int], int] = {}

    def add(self, body: bytes, anchor: int, place: Place) -> None:
        i = self.number.setdefault((body, anchor), len(self.body))
        if i == len(self.body):
            self.body.append(body)
            self.anchor.append(anchor)
            self.places.append([])
        self.places[i].append(place)

    def blob(self) -> bytes:
        count = [sum(len(p[0]) for p in x) for x in self.places]
        doc, tag, low = (np.concatenate([p[k] for x in self.places for p in x]) for k in range(3))
        size = np.array([len(b) for b in self.body], np.int32)
        head = packed(np.array(self.anchor, U64), size, np.array(count, np.int32), doc, tag.astype(np.uint16), low.astype(np.int64))
        return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(self.body))

    def read(self, blob: bytes) -> None:
        cut = 8 + int.from_bytes(blob[:8], "little")
        anchor, size, count, doc, tag, low = unpacked(blob[8:cut])
        bodies = zstandard.ZstdDecompressor().decompress(blob[cut:], max_output_size=int(size.sum()) or 1)
        at = k = 0
        for a, n, c in zip(anchor.tolist(), size.tolist(), count.tolist(), strict=True):
            self.add(bodies[at : at + n], a, (doc[k : k + c], tag[k : k + c], low[k : k + c]))
            at, k = at + n, k + c

    def pieces(self) -> dict[int, dict[bytes, list[tuple[int, int]]]]:
        """anchor -> piece -> the (segment, offset) that have it: the segments cut to strings whose hashes occur at two places or more."""
        n = self.length
        size = np.array([len(b) for b in self.body], np.int64)
        begin = np.cumsum(size) - size
        prefix = prefix_hash(np.frombuffer(b"".join(self.body), np.uint8), _R)
        inverse = powers(_INVERSE, len(prefix))
        weight = np.array([sum(len(p[0]) for p in x) for x in self.places], np.int64)
        many = size - n + 1
        of = np.repeat(np.arange(len(size)), many)
        start = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        at = begin[of] + start
        h = (prefix[at + n] - prefix[at]) * inverse[at]
        order = np.argsort(h)
        new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        again = np.add.reduceat(weight[of[order]], new) > 1
        hit = np.zeros(len(of), bool)
        hit[order] = np.repeat(again, np.diff(np.append(new, len(of))))
        out: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        kept = np.flatnonzero(hit)
        cuts = np.searchsorted(of[kept], np.arange(len(size) + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            first, last = runs(start[kept[cuts[i] : cuts[i + 1]]])
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                out[self.anchor[i]][self.body[i][a : b + n]].append((i, a))
        return out

    def removals(self) -> tuple[np.ndarray, ...]:
        """doc, tag, low, high of what goes."""
        found: list[tuple[np.ndarray, ...]] = []
        weight = [sum(len(p[0]) for p in x) for x in self.places]

        def settle(batch: list[tuple[bytes, list[tuple[int, int]]]]) -> None:
            counts = np.array([sum(weight[i] for i, _ in where) for _, where in batch])
            for (_, where), starts in zip(batch, repeated_starts([b for b, _ in batch], counts, self.length), strict=True):
                first, last = runs(starts)
                for i, offset in where if len(first) else []:
                    for doc, tag, low in self.places[i]:
                        k = len(first)
                        base = np.repeat(low + offset, k)
                        found.append((np.repeat(doc, k), np.repeat(tag, k), base + np.tile(first, len(doc)), base + np.tile(last + self.length, len(doc))))

        batch, size = [], 0
        for own in self.pieces().values() if self.body else []:
            n = sum(map(len, own))
            if batch and size + n > SHARD:
                settle(batch)
                batch, size = [], 0
            batch += own.items()
            size += n
        if batch:
            settle(batch)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(4))


def repeated_starts(pieces: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """Where, in each piece, strings begin that stand at two places or more; a piece stands at ``counts`` places itself."""
    size = np.array([len(s) for s in pieces])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.full(begin[-1] + 1, 257, np.uint16)
    t[-1] = 0
    for b, s in zip(begin.tolist(), pieces, strict=False):
        t[b : b + len(s)] = np.frombuffer(s, np.uint8)
        t[b : b + len(s)] += 1
    of = np.repeat(np.arange(len(pieces)), size + 1)
    n = len(of)
    sa = suffix_array(t, length)
    shared = common_prefixes(t, sa, length, prefix_hash(t, _R), powers(_INVERSE, len(t) + 1))
    order = sa[sa < n]  # all but the sentinel
    order = order[order + length <= begin[of[order]] + size[of[order]]]
    if not len(order):
        return [np.empty(0, np.int64)] * len(pieces)
    run = np.flatnonzero((shared[order] < length) | (np.arange(len(order)) == 0))
    again = np.add.reduceat(counts[of[order]], run) > 1
    hit = np.sort(order[np.repeat(again, np.diff(np.append(run, len(order))))])
    return [x - b for x, b in zip(np.split(hit, np.searchsorted(hit, begin[1:-1])), begin.tolist(), strict=False)]


def text_blocks(docs: DataFrame, size: int) -> DataFrame:
    """block, n_bytes, rows (ids, tags, offsets), text (compressed), in the shared folder."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for chunk in chunks(batches, cap=size):
            tags = np.array([tag_of(chunk.bytes_of(i)) for i in range(chunk.n)], np.uint16)
            head = packed(chunk.batch.column(0).fill_null(LAST).to_numpy(), tags, chunk.offsets)
            arrays = [pa.array([uuid.uuid4().hex]), pa.array([len(chunk.data)], pa.int64()), pa.array([head], pa.binary()), pa.array([squeeze.compress(chunk.data.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "n_bytes", "rows", "text"])

    return table(docs.select("doc_id", "text").mapInArrow(run, "block string, n_bytes long, rows binary, text binary"), "texts")


def opened(head: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, tags, offsets and bytes of a block's texts."""
    ids, tags, offsets = unpacked(head)
    text = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(offsets[-1])))
    return ids, tags, offsets, np.frombuffer(text, np.uint8)


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK_BYTES, per_range: int = 1 << 20) -> DataFrame:
    """Rows of (bucket, blob): ranges of bytes to remove."""
    own = text_blocks(docs, block)
    n_bytes = own.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = 2 * n_bytes // (length - gram + 1)
    cells = Cells(CORES * anchors, 1, per_range=per_range)
    buckets = n_buckets(n_bytes)
    shards = int(1 + anchors * 1.4 * length * 0.3 // SHARD)

    def hashes(head, body):
        _, _, offsets, data = opened(head, body)
        return Anchors(data, offsets, length, gram).cores()[1]

    def segments(key, left, right):
        ids, tags, offsets, data = opened(left.column("rows")[0].as_py(), left.column("text")[0].as_py())
        x = Anchors(data, offsets, length, gram)
        who, h = x.cores()
        text = data.tobytes()
        by: dict[int, Shard] = defaultdict(lambda: Shard(length))
        for i in np.unique(who[Classes(right, cells).of(h) > 0]).tolist():
            d, low, anchor = int(x.doc[i]), int(x.low[i]), int(x.hash[i])
            by[anchor % shards].add(text[low : x.high[i]], anchor, (ids[d : d + 1], tags[d : d + 1], np.array([low - offsets[d]], np.int64)))
        return pa.table({"shard": pa.array(list(by), pa.int64()), "blob": pa.array([s.blob() for s in by.values()], pa.binary())})

    def sort(key, group):
        shard = Shard(length)
        for blob in group.column("blob"):
            shard.read(blob.as_py())
        bucket, blob = rows(*shard.removals(), buckets)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blob, pa.binary())})

    told = counted(own.select("block", "rows", "text"), hashes, cells)
    sent = own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(segments, "shard long, blob binary")
    return sent.groupBy("shard").applyInArrow(sort, "bucket long, blob binary")


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), with_bytes: bool = False) -> DataFrame:
    """The columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 (with_bytes: and kept_bytes, which may split characters); these replace columns of their names."""
    keep = carried_columns(keep, ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_bytes))
    docs = documents.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    found = table(removals(docs.select("doc_id", "text"), length, gram), "ranges")
    release(docs.sparkSession)  # the segments' shuffles end here
    both = with_ranges(docs, found, keep)

    def run(batches):
        for chunk in chunks(batches):
            gone = chunk.batch.column(chunk.batch.schema.get_field_index("_gone")).to_pylist()
            out = []
            for d in range(chunk.n):
                data = chunk.data[chunk.offsets[d] : chunk.offsets[d + 1]]
                mask = np.zeros(len(data), bool)
                if gone[d]:
                    mask = covered(len(data), *unpacked(gone[d]))
                left = data[~mask].tobytes()
                spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                out.append((len(data), int(mask.sum()), spans, hashlib.sha256(left).hexdigest(), *[left] * with_bytes))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_bytes]
            own = [chunk.batch.column(chunk.batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_bytes])

    schema = T.StructType([documents.schema[c] for c in keep]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return both.mapInArrow(run, schema.add("kept_bytes", "binary") if with_bytes else schema)
