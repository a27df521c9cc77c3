"""Benchmark decontamination over a stored, distributed positional inverted index.

1. ``Index.build`` turns texts into blocks of about ``BLOCK_BYTES`` and each block into
   postings, term -> ascending positions (differences, compressed), cut into ranges of
   terms.  The postings are dealt by ranges of terms and stored in the shared folder with the
   terms' bytes; a further benchmark reads them and no text.
2. A benchmark is a stated query set, taken in blocks of ``ITEM_BYTES`` that the driver
   holds one at a time.  Only stored ranges that its terms fall into are read; of these the
   postings of its terms go on, to the block that they belong to.
3. There a phrase starts from its rarest term: that term's list, less the term's offset, is
   intersected with the other terms' lists, rarest first.  Terms were compared byte for
   byte, so the answer is exact.  Proximity starts from the rarest term too, and asks
   each other term's list for a position that is near enough in the same text.
4. Matches meet their block's rows.

Words: ASCII letters lower-cased, then runs of 0-9, a-z and non-ASCII characters.  A
phrase is ``window`` consecutive words of an item, or the whole item if it has fewer.
Null or wordless texts and items match nothing; repeated items each count by their own id;
an item with null id is named "".  Rows are never merged: a repeated document gets a
result for each row.  Columns of the documents other than the id and the text play no part;
``key`` tells rows of one id apart (rows that share it are equal in id and text).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import settled, table
from .blobs import packed, unpacked
from .text import CACHES, NOT_ALNUM, U64, Words, chunks, covered

BLOCK_BYTES = 2 << 20
ITEM_BYTES = 2 << 20
BITS = 8  # of a term's hash that name its range
PART_BYTES = 16 << 20  # of text, whose postings a task stores together, and reads as a whole


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def terms_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct terms, ascending; how often each occurs; all positions, term by term)."""
    h = words.hashes()
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.empty(0, np.int64)
    return h[order][new], np.diff(np.append(new, len(h))), order


class Phrases:
    """The distinct phrases of some items, as rows of term numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])
        row, known = 0, {}
        for chunk in chunks(iter([batch])):
            words = Words(chunk, NOT_ALNUM)
            tokens = [words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
            known |= dict(zip(tokens, words.hashes().tolist(), strict=True))
            for d in range(chunk.n):
                own = tokens[words.first[d] : words.first[d + 1]]
                k = min(window, len(own))
                for i in range(len(own) - k + 1 if k else 0):
                    owners[tuple(own[i : i + k])].add(items[row][0])
                row += 1
        texts = list(owners)
        self.owners = [sorted(owners[t]) for t in texts]
        self.terms = sorted(known, key=lambda t: (known[t], t))
        self.hash = np.array([known[t] for t in self.terms], U64)
        number = {w: i for i, w in enumerate(self.terms)}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {len(t) for t in texts}:
            ids = np.array([i for i, t in enumerate(texts) if len(t) == k])
            self.by_length[k] = ids, np.array([[number[w] for w in texts[i]] for i in ids])


@lru_cache(maxsize=1)
def phrases_of(items: tuple[tuple[str, str], ...], window: int) -> Phrases:
    return Phrases(list(items), window)


CACHES.append(phrases_of.cache_clear)


class Postings:
    """One block's lists of the terms of some phrases; ``first`` are the first words of its rows, and its end."""

    def __init__(self, n_terms: int, term: np.ndarray, count: np.ndarray, positions: np.ndarray, first: np.ndarray):
        self.df = np.zeros(n_terms, np.int64)
        self.df[term] = count
        self.begin = np.zeros(n_terms, np.int64)
        self.begin[term] = np.cumsum(count) - count
        self.positions, self.first = positions, first

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.begin[term] + self.df[term]]

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def phrase(self, row: np.ndarray) -> np.ndarray:
        """First words of the phrase's occurrences."""
        order = np.argsort(self.df[row], kind="stable")
        at = self.list_of(row[order[0]]) - order[0]
        at = at[(at >= 0) & (at + len(row) <= self.first[-1])]
        for j in order[1:]:
            if not len(at):
                return at
            other = self.list_of(row[j])
            place = np.minimum(np.searchsorted(other, at + j), len(other) - 1)
            at = at[other[place] == at + j]
        return at[self.row_of(at) == self.row_of(at + len(row) - 1)]

    def near(self, row: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rarest term that have all the others at most ``reach`` words off in the same row."""
        order = np.argsort(self.df[row], kind="stable")
        p = self.list_of(row[order[0]])
        for j in order[1:]:
            other, own = self.list_of(row[j]), self.row_of(p)
            low, high = np.maximum(p - reach, self.first[own]), np.minimum(p + reach + 1, self.first[own + 1])
            p = p[np.searchsorted(other, high) > np.searchsorted(other, low)]
        return p


def matches(lists: Postings, phrases: Phrases, reach: int | None = None) -> Iterator[tuple[int, int, np.ndarray, str]]:
    """(phrase, its length, first words, kind) for phrases all of whose terms the block has."""
    for k, (ids, rows) in phrases.by_length.items():
        for i in np.flatnonzero(lists.df[rows].min(axis=1) > 0):
            if len(found := lists.phrase(rows[i])):
                yield ids[i], k, found, "phrase"
            if reach is not None and len(found := lists.near(rows[i], reach)):
                yield ids[i], 1, found, "near"


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """Blocks of (item_id, text); the driver holds one of them."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    for row in rows.toLocalIterator():
        if block and held + len(row[1]) > size:
            yield tuple(block)
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block:
        yield tuple(block)


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(doc_id, text)


FOUND = "block string, item_id string, kind string, n int, blob binary"


class Index:
    """A stored index: ``rows`` (block, ids ...) and ``postings`` (range, block, blob)."""

    def __init__(self, rows: DataFrame, postings: DataFrame):
        self.rows, self.postings = rows, postings

    @classmethod
    def build(cls, documents: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Index:
        docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

        def run(batches):
            for chunk in chunks(batches, cap=block_bytes):
                words = Words(chunk, NOT_ALNUM)
                ids = chunk.batch.column(0)
                head = packed(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), chunk.batch.column(2).to_numpy(), words.first.astype(np.int64))
                hashes, count, positions = terms_of(words)
                start = words.start[positions[np.cumsum(count) - count]]
                size = words.end[positions[np.cumsum(count) - count]] - start
                step = np.diff(positions, prepend=0)
                step[np.cumsum(count) - count] = positions[np.cumsum(count) - count]
                cuts = np.searchsorted(hashes >> U64(64 - BITS), np.arange((1 << BITS) + 1, dtype=U64))
                upto = np.concatenate([[0], np.cumsum(count)])
                parts = np.flatnonzero(np.diff(cuts)).tolist()
                blobs = [head]
                for p in parts:
                    a, b = cuts[p], cuts[p + 1]
                    text = gathered(words.data, start[a:b], size[a:b])
                    blobs.append(packed(hashes[a:b], count[a:b].astype(np.uint32), size[a:b].astype(np.uint32), step[upto[a] : upto[b]].astype(np.uint32), text, delta=1))
                name = uuid.uuid4().hex
                arrays = [pa.array([-1, *parts], pa.int32()), pa.array([name] * len(blobs)), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["range", "block", "blob"])

        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shares = 1 + n_bytes // (PART_BYTES << BITS)  # a range of a large corpus is stored by several tasks
        raw = docs.select("doc_id", "text", key_of().alias("key")).mapInArrow(run, "range int, block string, blob binary")
        parts = max(1, min((1 << BITS) * shares, 1 + n_bytes // PART_BYTES))
        share = F.pmod(F.xxhash64("block"), F.when(F.col("range") < 0, F.lit(parts)).otherwise(F.lit(shares)))  # rows of blocks are no range
        dealt = raw.repartition(parts, "range", share).sortWithinPartitions("range")
        stored = table(dealt, "postings")
        return cls(stored.where("range = -1").drop("range"), stored.where("range >= 0"))

    def found(self, items: tuple[tuple[str, str], ...], window: int, reach: int | None = None) -> DataFrame:
        """Rows of FOUND for a block of items: by item the first words of what occurs, in words of the document block."""
        ranges = sorted({int(h) >> (64 - BITS) for h in phrases_of(items, window).hash.tolist()})

        def select(batches):
            phrases = phrases_of(items, window)
            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hashes, count, size, step, text = unpacked(blob)
                    # several of the benchmark's terms may share a hash: each is compared by its bytes
                    low, high = np.searchsorted(phrases.hash, hashes), np.searchsorted(phrases.hash, hashes, side="right")
                    at, upto = np.cumsum(count, dtype=np.int64) - count, np.cumsum(size, dtype=np.int64)
                    who, term = [], []
                    for i in np.flatnonzero(high > low).tolist():
                        word = text[upto[i] - size[i] : upto[i]].tobytes()
                        for t in range(low[i], high[i]):
                            if phrases.terms[t] == word:
                                who.append(i)
                                term.append(t)
                    if who:
                        own = [np.cumsum(step[at[i] : at[i] + count[i]], dtype=np.int64) for i in who]
                        body = packed(np.array(term, np.int64), count[who].astype(np.int64), np.concatenate(own))
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body], pa.binary())], names=["block", "blob"])

        def match(key, left, right):
            out = []
            if left.num_rows and right.num_rows:
                phrases = phrases_of(items, window)
                term, count, positions = (np.concatenate(x) for x in zip(*(unpacked(b.as_py()) for b in right.column("blob")), strict=True))
                lists = Postings(len(phrases.terms), term, count, positions, unpacked(left.column("blob")[0].as_py())[3])
                by: dict[tuple[str, str, int], list[np.ndarray]] = defaultdict(list)
                for i, k, p, kind in matches(lists, phrases, reach):
                    for item in phrases.owners[i]:
                        by[item, kind, k].append(p)
                out = [(left.column("block")[0].as_py(), item, kind, k, packed(np.concatenate(p))) for (item, kind, k), p in by.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "item_id", "kind", "n", "blob"), columns, kinds, strict=True)})

        lists = self.postings.where(F.col("range").isin(ranges)).select("block", "blob").mapInArrow(select, "block string, blob binary")
        return self.rows.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(match, FOUND)

    def all_found(self, benchmark: DataFrame, window: int, reach: int | None, item_bytes: int) -> DataFrame:
        parts = [table(self.found(items, window, reach), "matches") for items in item_blocks(benchmark, item_bytes)]
        return reduce(DataFrame.unionByName, parts) if parts else self.rows.sparkSession.createDataFrame([], FOUND)

    def search(self, benchmark: DataFrame, window: int = 10, reach: int | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
        """One row per match: doc_id, item_id, kind ("phrase", or "near" where ``reach`` is given), first_word, n_words."""
        kinds = (("doc_id", pa.int64()), ("item_id", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()))

        def place(key, left, right):
            out = []
            if left.num_rows and right.num_rows:
                ids, null, _, first = unpacked(left.column("blob")[0].as_py())
                for item, kind, n, blob in zip(*(right.column(c).to_pylist() for c in ("item_id", "kind", "n", "blob")), strict=True):
                    p = unpacked(blob)[0]
                    row = np.searchsorted(first, p, side="right") - 1
                    out += [(None if null[r] else int(ids[r]), item, kind, int(x - first[r]), n) for r, x in zip(row.tolist(), p.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})

        found = self.all_found(benchmark, window, reach, item_bytes)
        schema = "doc_id long, item_id string, kind string, first_word long, n_words int"
        return self.rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(place, schema)

    def contamination(self, benchmark: DataFrame, window: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
        """One row per document: doc_id, key, n_words, n_hit, n_items, items (sorted ids), contaminated."""

        def judge(key, left, right):
            if not left.num_rows:
                return pa.table({n: pa.array([], t) for n, t in kinds})
            ids, null, keys, first = unpacked(left.column("blob")[0].as_py())
            rows = len(ids)
            mask = np.zeros(int(first[-1]), bool)
            items: list[set[str]] = [set() for _ in range(rows)]
            for item, n, blob in zip(*(right.column(c).to_pylist() for c in ("item_id", "n", "blob")), strict=True):
                p = unpacked(blob)[0]
                mask |= covered(len(mask), p, p + n)
                for r in set((np.searchsorted(first, p, side="right") - 1).tolist()):
                    items[r].add(item)
            upto = np.concatenate([[0], np.cumsum(mask)])
            hit = upto[first[1:]] - upto[first[:-1]]
            values = (pa.array(ids, mask=null), pa.array(keys), pa.array(np.diff(first)), pa.array(hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            return pa.table({n: v for (n, _), v in zip(kinds, values, strict=True)})

        kinds = (("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())))
        found = self.all_found(benchmark, window, None, item_bytes)
        schema = "doc_id long, key long, n_words long, n_hit long, items array<string>"
        out = self.rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(judge, schema)
        return out.select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def search(documents: DataFrame, benchmark: DataFrame, window: int = 10, reach: int | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``Index.search`` over an index made for it."""
    return Index.build(documents).search(benchmark, window, reach, item_bytes)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``Index.contamination`` over an index made for it."""
    return Index.build(documents).contamination(benchmark, window, item_bytes)


def contaminated_keys(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    return contamination(documents, benchmark, window).where("contaminated").select(F.col("key").alias("_bad")).distinct()


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, that share no phrase with the benchmark; the index goes as soon as these are known."""
    bad = settled(documents.sparkSession, lambda: table(contaminated_keys(documents, benchmark, window), "contaminated"))
    return documents.join(bad, key_of() == F.col("_bad"), "left_anti")


