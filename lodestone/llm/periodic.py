"""Periodic runs of words: every maximal stretch that repeats with a period, found by Lyndon roots.

The longest Lyndon word at each place, under an order of the words or under its
reverse, is a root of every run (H. Bannai and others, "The runs theorem").  So a
text is scanned from right to left twice, with a stack of places whose next
smaller suffix is known; two suffixes are compared, and a root is extended to
both sides, by binary search over rolling hashes.  What the hashes call equal is
compared word by word before it counts (and scanned where they err), so the
result does not depend on them.  What was compared for a distance is kept for
the next root with that distance: a long run is read once, not once a root.  No
suffix array is built.

A run of ``least`` words or more holds ``least // 2`` words in a row and again a
period later, which together cover it, so the scan starts from words covered
by windows of that size that occur twice in their text (found by hashes of a whole
batch, which can only add words); stretches between such words are scanned whole.

Words are runs of other bytes than ASCII white space, unchanged.  A null, empty
or blank text has no words and no runs.  Every row is a text of its own: repeated
rows and ids, null ids and equal texts change nothing, and nothing is shuffled.
A text is worked on whole, however long.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import U64, Words, carried_columns, chunks, covered, mix

LEAST = 12
DIRECT = 8  # words compared one by one before hashes are
_B = 0x9FB21C651E98DF25 | 1
_MASK = (1 << 64) - 1
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Lce:
    """Longest common extensions of a sequence of numbers with itself."""

    def __init__(self, x: list[int]):
        self.x, self.n = x, len(x)
        self.near: dict[int, tuple[int, int]] = {}  # distance q -> (s, t): x[y] == x[y + q] for s <= y < t, and not at t
        h = mix(np.array(x, U64) + U64(1))
        power = np.full(self.n + 1, _B, U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        prefix = np.zeros(self.n + 1, U64)
        np.cumsum(h * power[:-1], out=prefix[1:])
        self.hash, self.power = prefix.tolist(), power.tolist()

    def alike(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of k numbers from i and from j > i are equal."""
        h = self.hash
        return ((h[i + k] - h[i]) * self.power[j - i] - h[j + k] + h[j]) & _MASK == 0

    def forward(self, i: int, j: int) -> int:
        """How many numbers from i on equal those from j > i on."""
        x, q, most = self.x, j - i, self.n - j
        s, t = self.near.get(q, (0, -1))
        if s <= i <= t:
            return t - i
        k, stop = 0, min(DIRECT, most)
        while k < stop and x[i + k] == x[j + k]:
            k += 1
        if k < stop or k == most:
            return k
        if i < s <= t and self.alike(i, j, s - i) and x[i:s] == x[j : s + q]:
            self.near[q] = (i, t)
            return t - i
        low, high = k, most + 1  # equal for low numbers, not for high
        while high - low > 1:
            mid = min(2 * low, (low + high) // 2)
            low, high = (mid, high) if self.alike(i, j, mid) else (low, mid)
        if x[i : i + low] != x[j : j + low] or (low < most and x[i + low] == x[j + low]):  # the hashes err: word by word
            low = next((k for k in range(most) if x[i + k] != x[j + k]), most)
        self.near[q] = (i, i + low)
        return low

    def backward(self, i: int, j: int) -> int:
        """How many numbers before i equal those before j > i."""
        x, k, stop = self.x, 0, min(DIRECT, i)
        while k < stop and x[i - 1 - k] == x[j - 1 - k]:
            k += 1
        if k < stop or k == i:
            return k
        low, high = k, i + 1
        while high - low > 1:
            mid = min(2 * low, (low + high) // 2)
            low, high = (mid, high) if self.alike(i - mid, j - mid, mid) else (low, mid)
        if x[i - low : i] != x[j - low : j] or (low < i and x[i - low - 1] == x[j - low - 1]):
            low = next((k for k in range(i) if x[i - 1 - k] != x[j - 1 - k]), i)
        return low


def runs_of(x: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ``least`` numbers or more and of two periods or more."""
    n, lce, found = len(x), Lce(x), set()
    for reverse in (False, True):
        last: dict[int, tuple[int, int]] = {}  # period -> its run that was found last
        after = [n] * (n + 1)  # next place with a smaller suffix
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:  # while the suffix at i is smaller, its Lyndon word takes in the one at j
                if x[i] != x[j]:
                    smaller = x[i] < x[j]
                else:
                    k = lce.forward(i, j)
                    if j + k == n:
                        break
                    smaller = x[i + k] < x[j + k]
                if smaller == reverse:
                    break
                j = after[j]
            after[i] = j
            if j == n or (x[i] != x[j] and (not i or x[i - 1] != x[j - 1])):
                continue
            q = j - i
            s, e = last.get(q, (0, -1))
            if s <= i and j <= e:
                continue
            s, e = i - lce.backward(i, j), j + lce.forward(i, j)
            if e - s >= 2 * q:
                last[q] = (s, e)
                if e - s >= least:
                    found.add((s, e - s, q))
    return found


def stretches(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of a chunk's words, each within a row, that can hold runs."""
    at, h = words.windows(words.hashes(), max(1, least // 2))
    h = mix(h + words.doc[at].astype(U64) * U64(_B))  # equal windows of one row
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = at[again]
    inside = covered(len(words.doc), at, at + max(1, least // 2))
    edge = np.zeros(len(inside) + 1, bool)  # rows begin here
    edge[words.first] = True
    here, before = np.append(inside, False), np.append(False, inside)
    start, end = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
    long = end - start >= least
    return start[long], end[long]


def scan(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, column: str = "text") -> DataFrame:
    """The columns ``keep``, n_words, runs (start, length, period; by start, then period) and collapsed; these replace columns of their names.

    A run is a stretch of ``least`` words or more and of two of its smallest period or more, which no neighbour extends.
    ``collapsed`` has the words that no run holds after its first period, joined by a space.
    """
    made = ("n_words", "runs", "collapsed")
    keep = carried_columns(keep, made)

    def run(batches):
        for chunk in chunks(batches, column):
            words = Words(chunk, lower=False)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
            for a, b in zip(*(r.tolist() for r in stretches(words, least)), strict=True):
                own = [words.data[s:e].tobytes() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                number = {w: i for i, w in enumerate(dict.fromkeys(own))}
                d = int(words.doc[a])
                shift = a - int(words.first[d])
                found[d] += [(s + shift, n, q) for s, n, q in runs_of([number[w] for w in own], least)]
            texts = []
            for d, runs in enumerate(found):
                tokens = chunk.bytes_of(d).split()
                if runs:
                    runs.sort(key=lambda r: (r[0], r[2]))
                    s, n, q = np.array(runs).T
                    gone = covered(len(tokens), s + q, s + n)
                    tokens = [w for w, g in zip(tokens, gone.tolist(), strict=True) if not g]
                texts.append(b" ".join(tokens).decode())
            own = [chunk.batch.column(chunk.batch.schema.get_field_index(c)) for c in keep]
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([*own, pa.array(words.count, pa.int64()), runs, pa.array(texts, pa.string())], names=[*keep, *made])

    schema = T.StructType([documents.schema[c] for c in keep]).add("n_words", "long").add("runs", T._parse_datatype_string(RUNS)).add("collapsed", "string")
    return documents.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by the id's crc32, is made periodic from some word on, as the contract says.

    A row with null id, or without words, keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = documents.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = F.expr("int(g % n)")
    p = F.expr("int(1 + floor((n - a) / (3 + g % 8)))")
    split = split.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array(*repeat(period, 11))), F.lit(1), F.col("n") - F.col("a"))  # (n - a) / p is below 11
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def digests() -> list[Column]:
    """The contract's columns of what ``scan`` returns."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -best["less"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return [
        F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), best["period"].alias("period"),
        ((length * 1000 - F.pmod(length * 1000, best["period"])) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ]
