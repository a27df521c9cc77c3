"""The similarity indexes and greedy clusters against loops over everything; candidates are counted."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.similarity import token_sort_of
from lodestone.operators import graph, greedy, similar


def vectors(seed, n, dims=6, centres=12, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dims))
    return c[r.integers(0, centres, n)] + spread * r.standard_normal((n, dims))


def frame(spark, v, blocks=1):
    return spark.createDataFrame([(i, x.tolist(), i % blocks) for i, x in enumerate(v)], "id long, embedding array<double>, block long").repartition(3)


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


@pytest.mark.parametrize(("seed", "least", "spread", "size"), [(1, 0.92, 0.05, 2048), (2, 0.7, 0.3, 17), (3, 0.3, 1.0, 40), (4, -0.5, 1.0, 2048)])
def test_no_cosine_pair_is_lost(spark, seed, least, spread, size):
    v = vectors(seed, 150, spread=spread)
    s = cosines(v)
    want = {(i, j): s[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= least}
    got = {(r.a, r.b): r.sim for r in similar.cosine_pairs(frame(spark, v), least, size=size).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    got = {(r.a, r.b) for r in similar.cosine_pairs(frame(spark, v, 3), least, "block", size=size).collect()}
    assert got == {(i, j) for i, j in want if i % 3 == j % 3}


def test_few_cosines_are_formed(spark):
    v = vectors(5, 1200, dims=8, centres=60, spread=0.02)
    s = cosines(v)
    true = int((np.triu(s, 1) >= 0.92).sum())
    tested = similar.cosine_pairs(frame(spark, v), 0.92, with_counts=True).agg(F.sum("n_tested")).first()[0]
    assert true <= tested < len(v) * (len(v) - 1) / 2 / 8


def test_pairs_of_hard_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [-1.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert [(r.a, r.b, r.sim) for r in similar.cosine_pairs(d, 0.9).collect()] == [(1, 2, 1.0)]
    assert similar.cosine_pairs(d.where("id > 9"), 0.9).count() == 0


def ratio(a, b):
    return round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)


@pytest.mark.parametrize("least", [0.45, 0.6, 0.8, 0.88, 0.95])
def test_no_ratio_pair_is_lost(spark, least):
    r = random.Random(int(100 * least))
    names = {"".join(r.choices("abcdefg ", k=r.randint(1, 14))) for _ in range(70)}
    for n in sorted(names)[:40]:
        x = list(n)
        for _ in range(r.randint(1, 2)):
            x[r.randrange(len(x))] = r.choice("abcdefgh")
        names |= {"".join(x), n + r.choice("abc"), n[1:] or "z", n * 2}
    names = sorted(names)
    d = spark.createDataFrame([(n,) for n in [*names, "", None, names[0]]], "name string").repartition(3)
    got = {(x.a, x.b): x.score for x in similar.ratio_pairs(d, least).collect()}
    assert got == {(a, b): ratio(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if ratio(a, b) >= least}


def test_few_ratios_are_formed(spark):
    r = random.Random(9)
    base = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=r.randint(12, 24))) for _ in range(300)]
    names = sorted({*base, *(b[:5] + "x" + b[6:] for b in base)})
    x = spark.createDataFrame([(n,) for n in names], "name string")
    true = sum(ratio(a, b) >= 0.88 for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) < 6)
    tested = similar.ratio_candidates(x, x, 0.88).where("a < b").count()
    assert 290 <= true <= tested < len(names) ** 2 / 2 / 50


def test_matches_of_two_tables(spark):
    one = spark.createDataFrame([("einstien",), ("curie",), ("a",)], "name string")
    two = spark.createDataFrame([("einstein",), ("curie",), ("b",), (None,)], "name string")
    assert {(r.a, r.b) for r in similar.ratio_matches(one, two, 0.8).collect()} == {("einstien", "einstein"), ("curie", "curie")}


def one_by_one(ids, v, least, centroid):
    """(id, leader): row by row."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    heads, sums, out = [], [], {}
    for i in ids:
        sims = [float(np.round(s @ v[i] / np.linalg.norm(s), 6)) for s in sums]
        good = [k for k, s in enumerate(sims) if s >= least]
        if good:
            k = max(good, key=lambda k: (sims[k], -k)) if centroid else good[0]
            out[i] = heads[k]
            if centroid:
                sums[k] = sums[k] + v[i]
        else:
            heads.append(i)
            sums.append(v[i])
            out[i] = i
    return out


@pytest.mark.parametrize("centroid", [False, True])
@pytest.mark.parametrize(("seed", "least", "spread"), [(1, 0.92, 0.2), (2, 0.8, 0.4), (3, 0.5, 0.8), (4, 0.92, 0.1)])
def test_leaders_equal_one_by_one(spark, seed, least, spread, centroid):
    v = vectors(seed, 90, dims=4, centres=10, spread=spread)
    v[10:14] = v[3]  # copies
    order = random.Random(seed).sample(range(90), 90)
    rank = {i: k for k, i in enumerate(order)}
    d = spark.createDataFrame([(i, x.tolist(), i % 2, rank[i] // 2, -rank[i]) for i, x in enumerate(v)], "id long, embedding array<double>, block long, first int, second int").repartition(4)
    got = {r.id: r.leader for r in greedy.leaders(d, least, order=("first", "second"), centroid=centroid).collect()}
    want = {}
    for b in (0, 1):
        ids = [i for i in sorted(range(90), key=lambda i: (rank[i] // 2, -rank[i])) if i % 2 == b]
        want |= one_by_one(ids, v, least, centroid)
    assert got == want
    assert "FlatMapGroupsInPandas" not in greedy.leaders(d, 0.99)._jdf.queryExecution().executedPlan().toString()


def test_long_chains_of_decisions(spark):
    angle = np.arange(40) * 0.1
    v = np.stack([np.cos(angle), np.sin(angle)], 1)
    d = frame(spark, v).withColumn("block", F.lit(0))
    got = {r.id: r.leader for r in greedy.leaders(d, float(np.cos(0.15))).collect()}
    assert got == one_by_one(range(40), v, float(np.cos(0.15)), False)


def test_leaders_of_hard_rows(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, [1.0, 0.0], None), (5, [1.0, 0.0], None)]
    d = spark.createDataFrame(rows, "id long, embedding array<double>, block long")
    for centroid in (False, True):
        got = {r.id: r.leader for r in greedy.leaders(d, 0.9, centroid=centroid).collect()}
        assert got[1] == 1 and got[2] == 2 and set(got) == {1, 2, 3, 4, 5}
    assert greedy.leaders(d.where("id > 9"), 0.9).count() == 0


def test_each_vector_is_sent_a_fixed_number_of_times(spark):
    for n in (9000, 18000):
        cells = spark.range(n).select(F.lit("all").alias("block"), "id", F.array(F.lit(1.0)).alias("x"), F.lit(0).alias("home"), F.lit(0).alias("cell"))
        dealt = similar._dealt(cells, similar.TILE)
        assert dealt.count() == n * similar.PARTS and "dist" not in dealt.columns


@pytest.mark.parametrize("least", [0.2, 0.9])
def test_links_connect_what_pairs_connect(spark, least):
    v = vectors(6, 400, dims=6, centres=30, spread=0.3)
    d = frame(spark, v, 2)
    links = similar.cosine_links(d, least, "block")
    pairs = similar.cosine_pairs(d, least, "block")
    of = lambda e: {r.iri: r.component for r in graph.components(e).collect()}
    assert of(links) == of(pairs) and (links.count() < pairs.count() / 4 if least < 0.5 else True)


def test_hybrid_pairs_score_each_two_names_once(spark, monkeypatch):
    v = vectors(7, 240, dims=4, centres=12, spread=0.6)
    base = ["red bolt", "Bolt red", "red bolts", "abcd", "bcda", "", None, "old ring", "cold ring", "kappa abd", "kappa adb", "kappa ab", "a b", "b a"]
    names = [base[i * 5 % len(base)] for i in range(len(v))]
    d = spark.createDataFrame([(f"k{i}", n, x.tolist()) for i, (n, x) in enumerate(zip(names, v, strict=True))], "id string, name string, vector array<double>").repartition(3)
    s = cosines(v)
    ids = sorted(range(len(v)), key=lambda i: f"k{i}")
    want = {}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if s[i, j] >= 0.9 or (s[i, j] >= 0.1 and token_sort_of(names[i], names[j]) >= 88):
                want[f"k{i}", f"k{j}"] = s[i, j]
    rows = similar.hybrid_pairs(d, 0.9, 0.1, 88).collect()
    got = {(r.a, r.b): r.sim for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(got) and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    scored = []
    real = similar.ratio_matches
    monkeypatch.setattr(similar, "ratio_matches", lambda x, y, *rest: scored.append(x.count()) or real(x, y, *rest))
    similar.hybrid_pairs(d, 0.9, 0.1, 88)
    assert scored == [len({" ".join(sorted((n or "").lower().split())) for n in base})]


def test_pairs_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "HELD", 100)
    monkeypatch.setattr(similar, "PRODUCTS", 512)
    v = vectors(8, 300, dims=4)
    s = cosines(v)
    got = {(r.a, r.b) for r in similar.cosine_pairs(frame(spark, v), 0.3).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.3}


def test_centroid_clusters_need_no_pairs(spark, monkeypatch):
    v = vectors(9, 300, dims=4, spread=0.5)
    d = frame(spark, v).withColumn("block", F.lit(0))
    edges, real = [], greedy.components
    monkeypatch.setattr(greedy, "components", lambda e: edges.append(e.count()) or real(e))
    got = {r.id: r.leader for r in greedy.leaders(d, 0.6, centroid=True).collect()}
    assert got == one_by_one(range(300), v, 0.6, True) and edges[0] < 2 * 300 * 2
