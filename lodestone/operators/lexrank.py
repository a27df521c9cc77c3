"""LexRank: the sentences of a text by their centrality in its graph of similar sentences (G. Erkan, D. Radev, 2004).

Sentences are vectors of term frequencies times inverse frequencies over the text's own
sentences; an edge weighs as much as the cosine of its ends where that is above
``least``.  Ranks are those of a random walk that jumps with probability 1 - ``damping``,
by power iteration on the matrix of a text.

A text of more than ``window`` sentences is ranked in windows of that many, one after the other,
and a sentence's rank is that in its window times the window's share of sentences, so work
and memory grow with the text and not with its square.  A text of one sentence gives it rank 1; null
and empty texts give no sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .text import sentences, words

WINDOW = 400
RANKED = "array<struct<place:int,rank:double>>"


def ranks_of(term_lists: list[list[str]], least: float = 0.1, damping: float = 0.85, precision: float = 1e-9, most: int = 200) -> list[float]:
    """A rank for each list of terms; they add up to 1."""
    import numpy as np

    n = len(term_lists)
    number: dict[str, int] = {}
    rows, cols = [], []
    for i, terms in enumerate(term_lists):
        rows += [i] * len(terms)
        cols += [number.setdefault(t, len(number)) for t in terms]
    counts = np.zeros((n, max(1, len(number))))
    np.add.at(counts, (rows, cols), 1.0)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1
    v = counts * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    weight = np.round(v @ v.T, 9)
    weight[weight < least] = 0
    np.fill_diagonal(weight, 0)
    total = weight.sum(1, keepdims=True)
    walk = np.where(total > 0, weight / np.where(total > 0, total, 1), 1 / n)  # a sentence like no other: anywhere
    rank = np.full(n, 1 / n)
    for _ in range(most):
        after = (1 - damping) / n + damping * (rank @ walk)
        if np.abs(after - rank).sum() < precision:
            return after.tolist()
        rank = after
    return rank.tolist()


def windowed(term_lists: list[list[str]], window: int = WINDOW, **options) -> list[float]:
    out = []
    for i in range(0, len(term_lists), window):
        part = term_lists[i : i + window]
        out += [x * len(part) / len(term_lists) for x in ranks_of(part, **options)]
    return out


def ranked(docs: DataFrame, id_col: str = "source_iri", text: str = "text", window: int = WINDOW, least: float = 0.1, damping: float = 0.85) -> DataFrame:
    """id_col, place (from 0), sentence, rank: all sentences of each text; the texts' rows are not shuffled."""
    whole = docs.select(F.col(id_col), F.coalesce(sentences(text), F.array().cast("array<string>")).alias("sentence"))
    terms = whole.withColumn("terms", F.transform("sentence", lambda s: words(s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, place, said, rank = [], [], [], []
            for i in range(batch.num_rows):
                own = batch.column(2)[i].as_py() or []
                ids += [i] * len(own)
                place += range(len(own))
                said.append(batch.column(1)[i].values)
                rank += [round(x, 6) for x in windowed(own, window, least=least, damping=damping)]
            said = pa.concat_arrays([s.cast(pa.string()) for s in said if s is not None and len(s)]) if ids else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(place, pa.int32()), said, pa.array(rank, pa.float64())], names=[id_col, "place", "sentence", "rank"])

    schema = T.StructType([docs.schema[id_col]]).add("place", T.IntegerType()).add("sentence", "string").add("rank", "double")
    return terms.mapInArrow(run, schema)


def summaries(docs: DataFrame, n: int = 3, id_col: str = "source_iri", text: str = "text", **options) -> DataFrame:
    """id_col, summary: the n most central sentences of each text (ties: the first), in their order; '' for a text without sentences.  Ids are unique."""
    best = Window.partitionBy(id_col).orderBy(F.desc("rank"), "place")
    top = ranked(docs, id_col, text, **options).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n)
    said = top.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    told = said.select(id_col, F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("summary"))
    return docs.select(id_col).join(told, id_col, "left").select(id_col, F.coalesce("summary", F.lit("")).alias("summary"))
