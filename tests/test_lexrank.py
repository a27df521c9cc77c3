"""Ranks against a walk over plain dictionaries; windows; summaries."""

import math
import random

import pytest

from lodestone.operators import lexrank


def plain(lists, least=0.1, damping=0.85):
    n = len(lists)
    df = {}
    for x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    vectors = [{t: x.count(t) * idf[t] for t in set(x)} for x in lists]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]

    def cosine(i, j):
        dot = sum(v * vectors[j].get(t, 0) for t, v in vectors[i].items())
        return dot / (norm[i] * norm[j]) if norm[i] and norm[j] else 0

    w = [[c if i != j and (c := cosine(i, j)) >= least else 0 for j in range(n)] for i in range(n)]
    rank = [1 / n] * n
    for _ in range(300):
        given = [0.0] * n
        for i in range(n):
            total = sum(w[i])
            for j in range(n):
                given[j] += rank[i] * (w[i][j] / total if total else 1 / n)
        rank = [(1 - damping) / n + damping * g for g in given]
    return rank


@pytest.mark.parametrize("seed", range(4))
def test_ranks_equal_a_plain_walk(seed):
    r = random.Random(seed)
    lists = [r.choices("abcdefghij", k=r.randint(0, 6)) for _ in range(r.randint(1, 14))]
    got = lexrank.ranks_of(lists)
    assert got == pytest.approx(plain(lists), abs=1e-7) and sum(got) == pytest.approx(1)


def test_texts(spark):
    long = " ".join(f"Sentence {i} of many is like the others." for i in range(30))
    rows = [("a", "Cats eat fish. Dogs eat meat. Cats and dogs eat fish and meat. The sky is blue."), ("b", None), ("c", ""), ("d", "One sentence only."), ("e", long), (None, "Null has an id. It too.")]
    docs = spark.createDataFrame(rows, "source_iri string, text string").repartition(3)
    got = {}
    for r in lexrank.ranked(docs, window=8).collect():
        got.setdefault(r.source_iri, []).append((r.place, r.sentence, r.rank))
    assert set(got) == {"a", "d", "e", None} and got["d"] == [(0, "One sentence only.", 1.0)]
    assert max(got["a"], key=lambda x: x[2])[1] == "Cats and dogs eat fish and meat."
    assert [p for p, *_ in sorted(got["e"])] == list(range(30)) and sum(x[2] for x in got["e"]) == pytest.approx(1, abs=1e-4)
    told = {r.source_iri: r.summary for r in lexrank.summaries(docs.where("source_iri IS NOT NULL"), 2).collect()}
    assert told["b"] == told["c"] == "" and told["d"] == "One sentence only."
    assert "Cats and dogs eat fish and meat." in told["a"] and "sky" not in told["a"]
    assert lexrank.summaries(docs.limit(0)).count() == 0
