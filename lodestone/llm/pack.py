"""Packing into fixed token sequences, with neighbours along a Hilbert curve together.

1. Each task tokenizes its texts by distinct words (the tokenizer splits at white
   space, so a text's ids are those of its words in turn), hashes the ids into a
   vector, projects that to ``DIMS`` dimensions and takes its Hilbert key.  The ids
   are written once, as 16-bit numbers.
2. The small table (key, row, length) is range-sorted; partition totals and a
   running sum in each partition give every document its place on the curve.
   Ties of the key go by row number, so a big group of copies spreads over ranges.
3. Ids and places meet by row number; each row is cut at multiples of ``length``.

Only the last sequence is short.  A null or empty text is the end id alone.  Each
row of a repeated document is packed.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut, table
from .text import CACHES, trim

LENGTH, END_ID = 4096, 2
DIMS, BITS, HASHED = 4, 8, 1024
CACHED_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE, as a table for Latin-1 text."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)}


class WordIds(dict):
    """ASCII-lower-cased word -> its ids as 16-bit bytes; about ``most`` are kept."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.stand_in = _byte_characters()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.encoded(word)
        return ids

    def encoded(self, word: bytes) -> bytes:
        core = word.rstrip(b".,")
        if core and core != word and core[-1:].isalnum():  # letters or digits and marks are never one piece
            return self[core] + self[word[len(core) :]]
        text = word.decode()
        if text.isalpha() and max(text) <= "\xff":  # one run of letters, composed already: straight to the model
            pieces = self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.stand_in))
            return np.array([p.id for p in pieces], np.uint16).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def of(self, text: str) -> bytes:
        data = text.encode()
        words = (data if b"<|" in data else data.lower()).split()  # special tokens are matched in their own case
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def _words(path: str, most: int) -> WordIds:
    return WordIds(path, most)


CACHES.append(_words.cache_clear)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((HASHED, DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (n x dims, below 2**bits); J. Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    cells = np.clip((np.tanh(vectors) + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1)
    return hilbert(cells, bits)


def tokenized(documents: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, cached_words: int = CACHED_WORDS) -> DataFrame:
    """row, doc_id, n, key, ids (16-bit, with the end id), written to the shared folder."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        trim(_words.cache_clear)  # the tasks of one stage share their words
        words, project = _words(path, cached_words), _projection()
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [words.of(t or "") + end for t in part.column(2).to_pylist()]
                arrays = [np.frombuffer(x, np.uint16) for x in ids]
                vectors = np.array([np.bincount(a & (HASHED - 1), minlength=HASHED) @ project / np.sqrt(len(a)) / 4 for a in arrays])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(a) for a in arrays], pa.int64()), pa.array(curve_keys(vectors), pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "n", "key", "ids"])
        trim(_words.cache_clear)

    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return table(rows.mapInArrow(run, "row long, doc_id long, n long, key long, ids binary"), "pack")


def places(tokens: DataFrame) -> DataFrame:
    """row and first_token: where each document begins among all tokens, along the curve."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(tokens.select("key", "row", "n").repartitionByRange(parts, "key", "row").withColumn("part", F.spark_partition_id()))
    total, base = 0, []
    for part, n in sorted(ranged.groupBy("part").agg(F.sum("n")).collect()):  # one row a partition
        base.append((part, total))
        total += n
    bases = tokens.sparkSession.createDataFrame(base, "part int, base long")
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("before")).alias("first_token"))


def pack(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: and ids, as array<int>)."""
    tokens = tokenized(documents, tokenizer, end_id, cached_words)
    placed = tokens.select("row", "doc_id", "ids").join(places(tokens), "row").drop("row")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data, first in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "ids", "first_token")), strict=True):
                ids = np.frombuffer(data, np.uint16).astype("<u4")
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(first + at, length)
                    n = min(length - offset, len(ids) - at)
                    piece = ids[at : at + n]
                    rows.append((doc, at, n, zlib.crc32(piece.tobytes()), len(ids), sequence, offset, *[piece.tolist()] * with_ids))
                    at += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
