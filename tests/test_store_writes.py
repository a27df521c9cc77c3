"""Writers that meet at a store: none is lost, work is done again only where it must be, and inputs are worked out once."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.schema import QUADS
from lodestone.sources.store import Store


def quads(spark, graph, *subjects):
    return spark.createDataFrame([(graph, s, "p", "o", "literal", 0.5) for s in subjects], QUADS)


def held(store):
    return {(r.graph, r.s) for r in store.read().collect()}


class Interrupted(Store):
    """A store in which others write just before the first commits of this one."""

    def __init__(self, spark, path, others):
        super().__init__(spark, path)
        self.others, self.versions_made = list(others), 0

    def _version(self, df):
        self.versions_made += 1
        return super()._version(df)

    def _commit(self, number, versions):
        if self.others:
            self.others.pop(0)()
        return super()._commit(number, versions)


@pytest.mark.parametrize(("graph", "made"), [("a", 2), ("b", 1)])
def test_two_writers(spark, tmp_path, graph, made):
    path = str(tmp_path / "s")
    other = Store(spark, path)
    other.load(quads(spark, "a", "x"))
    mine = Interrupted(spark, path, [lambda: other.load(quads(spark, graph, "y"))])
    mine.load(quads(spark, "a", "z"))
    assert held(other) == {("a", "x"), (graph, "y"), ("a", "z")} and mine.versions_made == made


def test_updates_clears_and_loads(spark, tmp_path):
    path = str(tmp_path / "s")
    other = Store(spark, path)
    other.load(quads(spark, "a", "x").unionByName(quads(spark, "b", "x")))
    mine = Interrupted(spark, path, [lambda: other.load(quads(spark, "a", "y")), lambda: other.clear("b")])
    mine.rewrite(lambda q: q.withColumn("s", F.concat("s", F.lit("!"))))
    assert held(other) == {("a", "x!"), ("a", "y!")} and mine.versions_made == 3
    mine = Interrupted(spark, path, [lambda: other.load(quads(spark, "c", "n"))])
    mine.clear("a")
    assert held(other) == {("c", "n")}
    mine.replace(quads(spark, "d"))
    assert held(other) == set() and other.versions() == {}
    assert not [x for x in os.listdir(path) if x.startswith(("draft-", "incoming-"))]
    other.vacuum()
    assert sum(x.startswith("current-") for x in os.listdir(path)) == 1 and held(other) == set()


def test_an_input_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    store = Store(spark, str(tmp_path / "s"))
    store.load(quads(spark, "a", "x", "y").mapInPandas(count, QUADS))
    assert seen.value == 2 and len(held(store)) == 2
    store.replace(quads(spark, "b", "x", "y", "z").mapInPandas(count, QUADS))
    assert seen.value == 5 and held(store) == {("b", s) for s in "xyz"}


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.load(quads(spark, "a", "x"))
    with pytest.raises(Exception, match="(?i)raise|bad"):
        store.load(quads(spark, "a", "y").withColumn("s", F.raise_error(F.lit("bad"))))
    assert held(store) == {("a", "x")} and not [x for x in os.listdir(store.path) if x.startswith("incoming-")]
