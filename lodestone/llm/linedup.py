"""Line dedup: lines that several documents have stay in one of them, told by levelled sorted runs of line hashes.

``Runs`` is a log-structured store of keys.  A run is sorted and cut into buckets by
key; ``fanout`` runs of a level are merged into one of the next.  All runs of a
level are files of one bucketed table, so neither the merge nor the join of a
batch with a level moves what is stored: only the batch is shuffled.

1. Each text's lines become 96-bit hashes, written once.
2. The hashes go into the store in batches, by falling document id.  A batch counts its
   keys, merge-anti-joins the runs, which leaves out keys that a level already
   knows in enough documents, and adds the rest as a run.  As ids fall from batch to
   batch, the document that a key was settled with is its last.
3. All levels are merged; keys with enough documents meet the lines of the others,
   and the lines to drop meet the texts, by document.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased;
keys of fewer than ``least_chars`` code points are never dropped.  A null or empty
text is one empty line.  Every row is a document: rows with the same id count
each, and if theirs is the largest id, all of them keep the line.  A null id is
smaller than all others.  A line counts once a text.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.lineage import HOT_KEYS, LEAST_HOT, WRITE, hot_join, release, remove, settled, shared_dir, table
from .text import carried_columns, chunks

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
FIRST = -(1 << 63)  # stands for a null id, before all others
KEY = ["h", "h2"]
_WHITE = b" \t\n\x0b\x0c\r"


@contextmanager
def _writing(spark: SparkSession):
    """What the write of a table shuffled goes as soon as it ends."""
    before = {k: spark.conf.get(k) for k in WRITE}
    for k, v in WRITE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Runs:
    """Levels of sorted runs of (h, h2, docs, top): how many documents a key is in, and the largest id of them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.runs: list[int] = []  # how many of each level

    def _place(self, level: int) -> str:
        return f"{shared_dir(self.spark).rstrip('/')}/{self.name}_{level}"

    def _append(self, level: int, run: DataFrame) -> None:
        while len(self.runs) <= level:
            self.runs.append(0)
        writer = run.select(*KEY, "docs", "top").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        if not self.runs[level]:
            writer = writer.option("path", self._place(level))
        with _writing(self.spark):
            writer.mode("append").saveAsTable(f"{self.name}_{level}")
        self.runs[level] += 1

    def level(self, level: int) -> DataFrame:
        """Each key of a level once."""
        stored = self.spark.table(f"{self.name}_{level}")
        return stored if self.runs[level] == 1 else stored.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _merge(self, level: int) -> None:
        self._append(level + 1, self.level(level))
        self._forget(level)

    def _forget(self, level: int) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_{level}")
        remove(self.spark, self._place(level))
        self.runs[level] = 0

    def unknown(self, keys: DataFrame, docs: int = 1, below: int | None = None) -> DataFrame:
        """The keys that no level has in so many documents; with ``below``, those counted more often than that stay as well."""
        for level, n in enumerate(self.runs):
            if n:
                known = self.level(level).where(F.col("docs") >= docs).select(*[F.col(k).alias("_" + k) for k in KEY])
                same = (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))
                keys = keys.join(known, same if below is None else same & (F.col("docs") <= below), "left_anti")
        return keys

    def add(self, counted: DataFrame) -> None:
        """A batch, with each of its keys once, as a run; then levels that are full are merged."""
        self._append(0, counted)
        level = 0
        while self.runs[level] >= self.fanout:
            self._merge(level)
            level += 1

    def merged(self) -> DataFrame:
        """All levels as one run."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self._merge(level)
        last = len(self.runs) - 1
        if self.runs[last] > 1:
            self._merge(last)
        return self.level(len(self.runs) - 1)

    def drop(self) -> None:
        for level, n in enumerate(self.runs):
            if n:
                self._forget(level)


def keys_of(text: bytes, least_chars: int = LEAST_CHARS) -> list[bytes]:
    """The key of each line, None if it is too short."""
    keys = [line.strip(_WHITE).lower() for line in text.split(b"\n")]
    return [k if len(k) >= least_chars and (k.isascii() or len(k.decode()) >= least_chars) else None for k in keys]


def line_hashes(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, tag (of the text), h, h2: each text's keys, once; ``documents`` has doc_id, text."""
    named = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")

    def run(batches):
        for chunk in chunks(batches):
            count, digests = [], []
            for d in range(chunk.n):
                keys = {k for k in keys_of(chunk.bytes_of(d), least_chars) if k is not None}
                count.append(len(keys))
                digests += map(xxhash.xxh3_128_digest, keys)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(chunk.n), count)
            doc, tag = (chunk.batch.column(i).to_numpy()[row] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(h[:, 0]), pa.array(h[:, 1].astype(np.int32))], names=["doc", "tag", *KEY])

    return named.mapInArrow(run, "doc long, tag long, h long, h2 int")


def counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("top"))


def batches_of(lines: DataFrame, n: int) -> list[DataFrame]:
    """``lines`` in n parts of about the same size, by falling document; a document is in one part."""
    marks = lines.agg(F.percentile_approx("doc", F.lit([i / n for i in range(1, n)]), F.lit(10_000))).first()[0] or []
    marks = sorted(set(marks))
    low, high = [None, *marks], [*marks, None]
    out = []
    for a, b in reversed(list(zip(low, high, strict=True))):
        part = lines if a is None else lines.where(F.col("doc") > a)
        out.append(part if b is None else part.where(F.col("doc") <= b))
    return out


def drops(documents: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc, tag, gone (the hashes h of lines to drop) of the documents that lose lines, in the shared folder."""
    spark = documents.sparkSession

    def make():
        lines = table(line_hashes(documents, least_chars), "lines")
        n, runs = lines.count(), Runs(spark, fanout)
        hot = max(LEAST_HOT, n // batches // HOT_KEYS)
        for part in batches_of(lines, batches):
            runs.add(runs.unknown(counted(part), least_docs, below=hot))  # what is hot in a batch is counted on, for the join
        repeated = runs.merged().where(F.col("docs") >= least_docs)
        found = hot_join(lines, repeated, KEY, "docs", n // batches).where("doc <> top")
        out = table(found.groupBy("doc", "tag").agg(F.collect_set("h").alias("gone")), "drops")
        runs.drop()
        return out

    return settled(spark, make)


def dedup(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = False) -> DataFrame:
    """The columns ``keep``, n_lines, n_dropped, kept_sha256 (with_text: and kept_text); these replace columns of their names.

    A line whose key at least ``least_docs`` documents have stays only in the one with the largest id.
    """
    made = ("n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text)
    keep = carried_columns(keep, made)
    docs = documents.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    gone = drops(docs.select("doc_id", "text"), least_docs, least_chars, batches, fanout).toDF("_doc", "_tag", "_gone")
    release(docs.sparkSession)
    own = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "_tag": F.xxhash64("text")})
    both = own.join(gone, ["_doc", "_tag"], "left").select(*dict.fromkeys([*keep, "text"]), "_gone")

    def run(batches):
        for chunk in chunks(batches):
            lines, lost, sha, texts = [], [], [], []
            for d, hashes in enumerate(chunk.batch.column(chunk.batch.schema.get_field_index("_gone")).to_pylist()):
                text = chunk.bytes_of(d)
                n = left = text.count(b"\n") + 1
                if hashes:
                    hashes = set(hashes)
                    keys = keys_of(text, least_chars)
                    digest = lambda k: int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True)
                    kept = [line for line, k in zip(text.split(b"\n"), keys, strict=True) if k is None or digest(k) not in hashes]
                    text, left = b"\n".join(kept), len(kept)
                lines.append(n)
                lost.append(n - left)
                sha.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            own = [chunk.batch.column(chunk.batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string()), *[pa.array(texts, pa.string())] * with_text], names=[*keep, *made])

    schema = T.StructType([documents.schema[c] for c in keep]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    return both.mapInArrow(run, schema.add("kept_text", "string") if with_text else schema)


def fresh(runs: Runs, batch: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """For batches that arrive one after the other: doc, tag, h, h2 of lines that no earlier batch has; the batch joins the runs."""
    lines = table(line_hashes(batch, least_chars), "lines")
    new = table(runs.unknown(lines), "fresh")
    runs.add(counted(new))
    return new
