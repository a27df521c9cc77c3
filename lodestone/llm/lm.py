"""Scoring by a bigram model with deleted interpolation.

P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), where the weights depend on
the bucket of the context's frequency, floor(log2 c(v)); an unseen context has no
first term.  All counts cover all training texts.  The weights are learned by
expectation-maximisation on held-out counts: each training token is judged by the
counts without itself, (c(v, w) - 1) / (c(v) - 1) and so on.

1. Texts become blocks of about ``BLOCK`` tokens: a dictionary of word hashes and the
   tokens as numbers into it, written once to the shared folder.
2. Each block sends its distinct words and bigrams, sorted by hash and cut into
   ranges, with their counts in training texts; a range's task adds the blocks'
   counts and returns to each block those of its own entries, in order.  A word
   that every text has costs a block one entry.
3. Each block, given its counts, yields bins of (bucket, ratio, count) for the weights
   and keeps the counts; the bins are few, whatever the input.
4. With the weights known, blocks are scored without another shuffle.

Tokens: ASCII letters lower-cased, runs of other bytes than ASCII white space, then
one end.  Null and empty texts are the end alone.  A row with null id is a training
row.  Repeated rows count as often as they occur.  With no training text at all,
scores rest on l0 alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blobs import packed, unpacked
from ..plans.lineage import table
from .text import U64, Words, chunks, mix

BLOCK = 1 << 20
ENTRIES = 1 << 20
END, START = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
STEP = 4  # bins an octave
ROUNDS = 200


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U64(0xD1342543DE82EF95) + w * U64(0xAF251AF3B0F025B5) + U64(1))


def blocks(documents: DataFrame, held_out: str) -> DataFrame:
    """block, n_tokens and blob: ids, null ids, held-out marks and lengths of the rows; dictionary; tokens."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            ids, null, out, n, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words, token = np.unique(tokens, return_inverse=True)
            blob = [packed(ids, null, out, n), packed(words, delta=1), packed(token.astype(np.uint32))]
            return pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().hex]), "n_tokens": pa.array([len(tokens)], pa.int64()), "rows": pa.array(blob[:1], pa.binary()), "words": pa.array(blob[1:2], pa.binary()), "tokens": pa.array(blob[2:], pa.binary())})

        for chunk in chunks(batches):
            words = Words(chunk)
            h = np.insert(words.hashes(), words.first[1:], END)
            ids = chunk.batch.column(0)
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), chunk.batch.column(2).to_numpy(zero_copy_only=False), words.count + 1, h))
            if sum(len(x[4]) for x in held) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return table(documents.select("doc_id", "text", held_out).mapInArrow(run, "block string, n_tokens long, rows binary, words binary, tokens binary"), "blocks")


class Block:
    """A block's tokens with their contexts, and its entries: distinct words (and START), then bigrams, by hash."""

    def __init__(self, rows: bytes, words: bytes, tokens: bytes):
        self.ids, self.null, self.held_out, self.n = unpacked(rows)
        (dictionary,) = unpacked(words)
        (token,) = unpacked(tokens)
        self.hash = np.append(dictionary, START)
        self.w = token.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        self.v[self.first] = len(dictionary)
        self.train = np.repeat(~self.held_out, self.n)
        code = self.v * len(self.hash) + self.w
        pairs, self.pair = np.unique(code, return_inverse=True)
        own = pair_hash(self.hash[pairs // len(self.hash)], self.hash[pairs % len(self.hash)])
        entry = np.concatenate([self.hash, own])
        self.kind = np.concatenate([np.zeros(len(self.hash), np.uint8), np.ones(len(own), np.uint8)])
        self.order = np.argsort(entry, kind="stable")
        self.entry = entry[self.order]

    def counts(self) -> np.ndarray:
        """In training rows of this block; START counts texts."""
        word = np.bincount(self.w[self.train], minlength=len(self.hash))
        word[-1] = (~self.held_out).sum()
        pair = np.bincount(self.pair[self.train], minlength=len(self.kind) - len(self.hash))
        return np.concatenate([word, pair])[self.order]

    def of_tokens(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(v, w), c(v), c(w) of each token, from the entries' totals."""
        back = np.empty(len(total), np.int64)
        back[self.order] = total
        word, pair = back[: len(self.hash)], back[len(self.hash) :]
        return pair[self.pair], word[self.v], word[self.w]


def bucket(c: np.ndarray) -> np.ndarray:
    """floor(log2 c) + 1; 0 for 0."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def bins(c2: np.ndarray, cv: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, tokens) of training tokens, each judged without itself: bucket, -log2 of the bigram ratio, log2 of the word count."""
    c2, cv, cw = c2 - 1, cv - 1, cw - 1
    ratio = np.where(c2 > 0, 1 + np.round(-np.log2(np.maximum(c2, 1) / np.maximum(cv, 1)) * STEP), 0).astype(np.int64)
    word = np.where(cw > 0, 1 + np.round(np.log2(np.maximum(cw, 1)) * STEP), 0).astype(np.int64)
    return np.unique((bucket(cv) << 32) | (ratio << 16) | word, return_counts=True)


def weights(code: np.ndarray, n: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """l2, l1, l0 by bucket (65 x 3) from bins, by expectation-maximisation."""
    out = np.tile([0.4, 0.5, 0.1], (65, 1))
    out[0] = [0, 0.8, 0.2]
    if not total:
        return np.tile([0.0, 0.0, 1.0], (65, 1))
    b, ratio, word = code >> 32, (code >> 16) & 0xFFFF, code & 0xFFFF
    p = np.stack([np.where(ratio > 0, 2.0 ** (-(ratio - 1) / STEP), 0), np.where(word > 0, 2.0 ** ((word - 1) / STEP), 0) / max(1, total - 1), np.full(len(b), 1 / (distinct + 1))])
    for _ in range(ROUNDS):
        share = out[b].T * p
        share *= n / share.sum(0)
        new = np.stack([np.bincount(b, s, minlength=65) for s in share], axis=1)
        # a thousandth of a token for each part keeps all of them alive; unseen contexts have no bigram part
        new += 1e-3
        new[0, 0] = 0
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - out).max() < 1e-6
        seen = np.bincount(b, n, minlength=65) > 0
        out[seen] = new[seen]
        if done:
            break
    return out


def log_probability(c2, cv, cw, model: np.ndarray, total: int, distinct: int) -> np.ndarray:
    w = model[bucket(cv)]
    return np.log10(w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * cw / max(1, total) + w[:, 2] / (distinct + 1))


def score(documents: DataFrame, held_out: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` names a boolean column."""
    own = blocks(documents, held_out)
    tokens = own.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = 1 << max(0, int(tokens * 0.8 / ENTRIES).bit_length())
    shift = U64(64 - ranges.bit_length() + 1)

    def entries(batches):
        for batch in batches:
            for name, *blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                b = Block(*blob)
                c, kind = b.counts().astype(np.uint32), b.kind[b.order]
                cuts = np.searchsorted(b.entry >> shift, np.arange(ranges + 1).astype(U64)) if ranges > 1 else np.array([0, len(b.entry)])
                part = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_pydict({"range": pa.array(part, pa.int32()), "block": pa.array([name] * len(part)), "blob": pa.array([packed(b.entry[cuts[r] : cuts[r + 1]], c[cuts[r] : cuts[r + 1]], kind[cuts[r] : cuts[r + 1]], delta=1) for r in part], pa.binary())})

    def add(key, group):
        parts = [unpacked(x) for x in group.column("blob").to_pylist()]
        entry, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([p[1] for p in parts]), minlength=len(entry)).astype(np.uint64)
        word = np.zeros(len(entry), bool)
        word[at] = np.concatenate([p[2] for p in parts]) == 0
        word &= entry != START
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        blobs = [packed(total[x]) for x in np.split(at, ends)]
        n, distinct = int(total[word].sum()), int((total[word] > 0).sum())
        m = len(blobs)
        return pa.table({"range": pa.array([key[0].as_py()] * m, pa.int32()), "block": group.column("block"), "blob": pa.array(blobs, pa.binary()), "n": pa.array([n] + [0] * (m - 1), pa.int64()), "v": pa.array([distinct] + [0] * (m - 1), pa.int64())})

    counts = own.select("block", "rows", "words", "tokens").mapInArrow(entries, "range int, block string, blob binary").groupBy("range").applyInArrow(add, "range int, block string, blob binary, n long, v long")
    counts = table(counts, "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())

    def meet(key, left, right):
        b = Block(*(left.column(c)[0].as_py() for c in ("rows", "words", "tokens")))
        c2, cv, cw = b.of_tokens(np.concatenate([unpacked(x)[0] for x in right.sort_by("range").column("blob").to_pylist()]).astype(np.int64))
        t = b.train
        code, n = bins(c2[t], cv[t], cw[t])
        return pa.table({"rows": left.column("rows"), "tokens": pa.array([packed(c2.astype(np.uint32), cw.astype(np.uint64))], pa.binary()), "bins": pa.array([packed(code, n)], pa.binary())})

    met = table(own.groupBy("block").cogroup(counts.select("block", "range", "blob").groupBy("block")).applyInArrow(meet, "rows binary, tokens binary, bins binary"), "met")

    def open_bins(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                code, n = unpacked(blob)
                yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    learned = met.select("bins").mapInArrow(open_bins, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    model = weights(learned.column("code").to_numpy(), learned.column("n").to_numpy(), total, distinct)
    n_train_texts = documents.where(~F.col(held_out)).count()

    def final(batches):
        for batch in batches:
            for rows, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, null, out, n = unpacked(rows)
                c2, cw = (x.astype(np.int64) for x in unpacked(tokens))
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                cv = np.empty_like(cw)  # a context is the token before
                cv[1:] = cw[:-1]
                cv[first] = n_train_texts
                base = np.add.reduceat(np.log10((cw + 0.5) / (total + 0.5 * (distinct + 1))), first)
                own = np.add.reduceat(log_probability(c2, cv, cw, model, total, distinct), first)
                known = np.add.reduceat((cw > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(out), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), total), pa.int64()), pa.array(base), pa.array(own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.select("rows", "tokens").mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
