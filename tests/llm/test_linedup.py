"""Line dedup against brute force, for several numbers of batches and levels, and the store of runs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import linedup

from . import brute


def sample(seed=3, n=120):
    r = random.Random(seed)
    common = [f"{'Subscribe to our NEWSLETTER today'} {i}" for i in range(12)] + ["short line", "", "é" * 19 + " x", "x" * 19, "y" * 20]
    texts = []
    for i in range(n):
        own = [f"line {i} of one document only {j}" for j in range(r.randint(0, 4))]
        own += [r.choice(["", " ", "\t", "\r"]) + r.choice([str.upper, str])(x) + r.choice(["", "\x0b", "  "]) for x in r.choices(common, k=r.randint(0, 6))]
        r.shuffle(own)
        texts.append("\n".join(own))
    texts += [None, "", "\n\n", *["a line that three rows have, each with its own id"] * 3, *["a line that only two of the rows have, here"] * 2]
    return list(enumerate(texts))


@pytest.mark.parametrize(("batches", "fanout", "least_docs"), [(1, 2, 3), (4, 2, 3), (5, 3, 2), (9, 2, 4)])
def test_equals_brute_force(spark, batches, fanout, least_docs):
    docs = sample()
    got = linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), batches=batches, fanout=fanout, least_docs=least_docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == brute.op13(docs, least_docs)


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(linedup, "LEAST_HOT", 5)
    monkeypatch.setattr("lodestone.plans.lineage.LEAST_HOT", 5)
    monkeypatch.setattr(linedup, "HOT_KEYS", 8)
    docs = [(i, f"a line that a third of all rows have\nand one of document {i:09d}\n" + f"one that later rows share {max(i, 60):06d}") for i in range(300)]
    got = linedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == brute.op13(docs)


def test_one_id_in_many_rows(spark):
    line = "the same line of twenty characters or more"
    rows = [(7, line), (7, line), (5, line), (None, line), (None, f" {line.upper()}\nother")]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in got)
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept_text) for r in got) == [(0, 1, ""), (0, 1, "other"), (5, 1, ""), (7, 0, line), (7, 0, line)]


def test_levels(spark):
    runs = linedup.Runs(spark, fanout=2)
    key = lambda *pairs: spark.createDataFrame([(h, 0, n, h) for h, n in pairs], "h long, h2 int, docs long, top long")
    seen = []
    for batch in ([(1, 1), (2, 1)], [(1, 2)], [(3, 1)], [(2, 1), (4, 1)], [(1, 1)]):
        runs.add(key(*batch))
        seen.append([n for n in runs.runs if n])
    assert seen == [[1], [1], [1, 1], [1], [1, 1]]  # merged like a binary counter
    assert [r.h for r in runs.unknown(key((1, 1), (2, 1), (9, 1))).collect()] == [9]
    assert sorted(r.h for r in runs.unknown(key((1, 1), (2, 1), (9, 1)), docs=3).collect()) == [2, 9]
    assert {r.h: r.docs for r in runs.merged().collect()} == {1: 4, 2: 2, 3: 1, 4: 1}
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_what_is_stored_is_not_shuffled(spark):
    runs = linedup.Runs(spark, fanout=9)
    for _ in range(2):
        runs.add(spark.range(5000).select(F.col("id").alias("h"), F.lit(0).alias("h2"), F.lit(1).cast("long").alias("docs"), F.col("id").alias("top")))
    assert "Exchange" not in runs.level(0)._jdf.queryExecution().executedPlan().toString()
    runs.drop()


def test_batches_that_arrive(spark):
    runs = linedup.Runs(spark)
    day = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, second = "a first line of the corpus\nshort", "A FIRST LINE of the corpus \na line that only the second day has"
    assert linedup.fresh(runs, day(first, first)).count() == 2
    assert linedup.fresh(runs, day(second, None)).count() == 1
    assert linedup.fresh(runs, day(second)).count() == 0
    runs.drop()
