"""Hashes over batches: compaction keeps what counts; and distilling by a budget."""

import os

from pyspark.sql import functions as F

from lodestone.operators import text
from lodestone.streaming import streams


def test_compaction(spark, tmp_path):
    path, rows = str(tmp_path / "h"), lambda *x: spark.createDataFrame(list(x), "fragment_key string, content_hash string")
    h = streams.Hashes(spark, path)
    assert h.read().count() == 0 and h.folders() == []
    last = lambda: {(r.fragment_key, r.content_hash, r.at) for r in h.read().groupBy("fragment_key").agg(F.max_by("content_hash", "at").alias("content_hash"), F.max("at").alias("at")).collect()}
    h.add(rows(("a", "1"), ("b", "1")), 0)
    h.add(rows(("a", "2")), 1)
    h.add(rows(("a", "2")), 1)  # done again
    before = last()
    h.compact(1)
    assert last() == before == {("a", "2", 1), ("b", "1", 0)} and h.folders() == [(1, "base=1")] and h.read().count() == 2
    h.add(rows(("a", "3"), ("c", "1")), 2)
    assert {(r.fragment_key, r.content_hash) for r in h.read(2).collect()} == {("a", "2"), ("b", "1")}
    os.makedirs(f"{path}/base=2")  # a compaction that broke off
    assert h.folders() == [(1, "base=1"), (2, "batch=2")]
    h.compact(2)
    h.compact(2)  # done again
    assert last() == {("a", "3", 2), ("b", "1", 0), ("c", "1", 2)} and sorted(os.listdir(path)) == ["base=2"]


def test_incremental_with_compaction(spark, tmp_path):
    seen = []
    for n, x in enumerate(["1", "2", "2", "1", "3"]):
        spark.createDataFrame([("k", x), ("same", "s"), (f"new{n}", "n")], "fragment_key string, content_hash string").coalesce(1).write.json(str(tmp_path / f"in/{n}"))
        live = spark.readStream.schema("fragment_key string, content_hash string").option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        streams.incremental(live, str(tmp_path / "h"), str(tmp_path / "cp"), lambda d: seen.append(sorted(r.fragment_key for r in d.collect())), compact_every=2).start().awaitTermination()
    assert seen == [["k", "new0", "same"], ["k", "new1"], ["new2"], ["k", "new3"], ["k", "new4"]]
    assert sorted(os.listdir(tmp_path / "h")) == ["base=3", "batch=4"]


def test_distilling_by_a_budget(spark):
    noise = "# References\nx\n# A\n"
    sizes = [10, 110, 300, 600]  # kilobytes
    df = spark.createDataFrame([(n, noise + "y" * (n * 1024)) for n in sizes], "n long, text string")
    model = lambda t, name: F.concat(F.lit("by "), name)
    got = {r.n: r.x for r in df.select("n", F.substring(text.distilled("text", "budget_optimized", model), 1, 20).alias("x")).collect()}
    assert got == {10: (noise + "y" * 9)[:20], 110: "by conservative", 300: "by moderate", 600: "by aggressive"}
    less = df.select("n", F.length(text.distilled("text", "budget_optimized", least_triples=1)).alias("x")).collect()
    assert all(r.x == r.n * 1024 + 4 for r in less)
