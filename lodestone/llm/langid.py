"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in each task, as one dense matrix, and
sends only its nonzero cells; they are summed by (language, bucket), so what the
driver receives is at most languages x ``buckets`` cells.  The log-probability
matrix goes out with the scoring tasks, which look up all n-grams of a chunk at
once and sum them per text.

A text is lower-cased; every run of other characters than letters becomes one
space, and one more stands at either end.  ``und`` (score 0) is given to null
texts, texts without a letter, and where nothing was learned.  The score is the
winner's posterior probability.  Ties go to the alphabetically first language.
Rows with null id are scored; they count as training rows.  Null lang is never
learned.  A repeated row counts as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


from .text import carried_columns, trim

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHARS = 1 << 18
ROWS = 256  # whose texts are strings at the same time
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None], buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows (indptr, bucket numbers) of the texts' n-grams, and whether each text has a letter."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(["", *lowered, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])  # each text stands between two line ends
    letter = letters()[code]
    n_letters = np.concatenate([[0], np.cumsum(letter)])
    has = n_letters[bounds[1:]] > n_letters[bounds[:-1]]
    edge = np.zeros(len(code), bool)
    edge[bounds] = True
    keep = letter | edge
    keep[1:] |= letter[:-1]  # the first of a run of gaps stays
    at = np.flatnonzero(keep)
    gap = ~letter[at]
    at = at[~np.append(gap[:-1] & gap[1:] & ~edge[at][:-1], False)]
    c = np.where(letter[at], code[at], 32).astype(np.uint64)
    row_begin = np.searchsorted(at, bounds)
    row = np.repeat(np.arange(len(texts)), np.diff(row_begin))
    parts, rows = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(orders) + 1):
        # n-grams that begin in a row and end at its closing line end at the latest
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        if n in orders:
            first = np.arange(min(m, len(row)))
            ok = first + n - 1 <= row_begin[1:][row[first]]
            if n == 1:
                ok &= c[first] != 32
            first = first[ok]
            x = h[first]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append(((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
            rows.append(row[first])
    bucket, row = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(len(texts) + 1)), bucket[order], has


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    trim()
    for batch in batches:
        for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
            texts = part.column(part.schema.get_field_index(column)).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHARS):
                    size += len(texts[j] or "")
                    j += 1
                yield part.slice(i, j - i), texts[i:j]
                i = j
    trim()


def train(rows: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (buckets x languages, with the log prior as a last row) from columns text, lang."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch, texts in slices(batches, "text"):
            lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            indptr, bucket, _ = grams(texts, buckets)
            name = {x: k for k, x in enumerate(sorted(set(lang)))}
            of = np.repeat([name[x] for x in lang], np.diff(indptr))
            for x, k in name.items():
                total[x] = total.get(x, 0) + np.bincount(bucket[of == k], minlength=buckets)
                texts_of[x] = texts_of.get(x, 0) + lang.count(x)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * (len(at) + 1), pa.string()), "bucket": pa.array([*at.tolist(), buckets], pa.int32()), "n": pa.array([*n[at].tolist(), texts_of[x]], pa.int64())})

    cells = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    got = cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((buckets + 1, 0), np.float32)
    number = {x: k for k, x in enumerate(langs)}
    n = np.zeros((buckets + 1, len(langs)))
    n[got.column("bucket").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    gram = n[:-1] + smoothing
    return langs, np.vstack([np.log(gram / gram.sum(0)), np.log(n[-1] / n[-1].sum())]).astype(np.float32)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), with_fit: bool = False) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and, if wanted, fit; ``documents`` has a column text.

    ``fit`` is the mean log-likelihood of the text's n-grams in the predicted language, less that of n-grams
    spread evenly over the buckets: what is negative looks less like the language than noise does (0 for ``und``).
    Columns of ``keep`` with one of these names are replaced.
    """
    made = ("lang_pred", "score", "fit") if with_fit else ("lang_pred", "score")
    keep = carried_columns(keep, made)
    langs, logp = model
    carried = documents.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    def score(batches):
        table = carried.value
        buckets = table.shape[1] - 1
        for batch, texts in slices(batches, "text"):
            indptr, bucket, has = grams(texts, buckets) if langs else (np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32), np.zeros(len(texts), bool))
            gram = np.zeros((len(langs), len(texts)))
            n = np.diff(indptr)
            full = np.flatnonzero(n)
            for k in range(len(langs) if len(full) else 0):
                gram[k, full] = np.add.reduceat(table[k][bucket], indptr[:-1][full], dtype=np.float64)
            if langs:
                total = gram + table[:, buckets].astype(np.float64)[:, None]
                best = total.argmax(0)
                p = 1 / np.exp(total - total.max(0)).sum(0)
                fit = gram[best, np.arange(len(texts))] / np.maximum(n, 1) + np.log(buckets)
            else:
                best, p, fit = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array([langs[b] if h else "und" for b, h in zip(best, has, strict=True)], pa.string()), pa.array(np.where(has, p, 0.0), pa.float64()), *[pa.array(np.where(has, fit, 0.0), pa.float64())] * with_fit], names=[*keep, *made])

    cols = list(dict.fromkeys([*keep, "text"]))
    out = T.StructType([documents.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    out = out.add("fit", "double") if with_fit else out
    return documents.select(*cols).mapInArrow(score, out)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the held-out part; never for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
