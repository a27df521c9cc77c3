"""What storing a table leaves behind."""

import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.plans import lineage


def shuffled(spark):
    """Names of the shuffle blocks on this machine's disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def test_a_stored_table_keeps_no_shuffles(spark):
    before, setting = shuffled(spark), spark.conf.get(lineage.CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    stored = lineage.table(counts.join(counts.withColumnRenamed("n", "m"), "k"), "stored")
    for _ in range(50):  # removal is asked for at once, and done in the background
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before  # nobody collected the driver's garbage here, and ``counts`` is still held
    assert spark.conf.get(lineage.CLEANUP) == setting
    assert stored.agg(F.sum("n")).first()[0] == 1000 == counts.agg(F.sum("n")).first()[0]


def folders(spark):
    return {p.name.rsplit("-", 1)[0] for p in Path(lineage.shared_dir(spark).removeprefix("file:")).iterdir() if (p / "_SUCCESS").exists()}


def test_of_what_is_settled_only_the_result_stays(spark):
    def make(name, fail=False):
        first = lineage.table(spark.range(10), f"{name}-a")
        second = lineage.settled(spark, lambda: lineage.table(lineage.table(first.where("id > 2"), f"{name}-b").where("id > 4"), f"{name}-c"))
        assert {f"{name}-a", f"{name}-c"} <= folders(spark) and f"{name}-b" not in folders(spark)
        if fail:
            raise ValueError(name)
        return lineage.table(second.where("id > 6"), f"{name}-d")

    paths = []
    out = lineage.settled(spark, lambda: make("x"), paths)
    assert {f for f in folders(spark) if f[:2] == "x-"} == {"x-d"} and "x-d" in paths[0] and len(paths) == 1
    assert sorted(r.id for r in out.collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        lineage.settled(spark, lambda: make("y", fail=True))
    assert not {f for f in folders(spark) if f[:2] == "y-"}


def test_small_tables_have_few_files(spark):
    cores = spark.sparkContext.defaultParallelism

    def make():
        lineage.few_files(1)
        return lineage.table(spark.range(0, 1000, 1, 20 * cores), "few")

    out = lineage.settled(spark, make)
    assert len(out.inputFiles()) == cores and out.count() == 1000
    assert lineage.cut(spark.range(0, 1000, 1, 20 * cores), 1000).rdd.getNumPartitions() == cores
    assert lineage.cut(spark.range(0, 1000, 1, 20 * cores), 10**9).rdd.getNumPartitions() == 20 * cores


def test_stored_rows_go_to_python_a_few_at_a_time(spark):
    setting = spark.conf.get(lineage.BATCH)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": pa.array([b.nbytes >> 20], pa.int64())})

    wide = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("x"))
    out = [r.mb for r in lineage.table(wide.mapInArrow(sizes, "mb long"), "sizes").collect()]
    assert sum(out) >= 36 and max(out) <= 10
    assert spark.conf.get(lineage.BATCH) == setting
