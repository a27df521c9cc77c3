"""Invalidation events exactly once, over a failure between the two writes of a batch."""

import json

import pytest

from lodestone.streaming import outbox

DEPS = [("a1", "fragment", "f1"), ("a2", "fragment", "f2"), ("a3", "artifact", "a1"), ("a4", "artifact", "a3"), ("a4", "fragment", "f2"), ("a5", "fragment", "f5"), ("a6", "artifact", "a7"), ("a7", "artifact", "a6"), ("a7", "fragment", "f7")]


def test_cascade(spark):
    deps = spark.createDataFrame([*DEPS, (None, "x", "f1"), ("a9", "x", None)], outbox.DEPS)
    found = lambda *refs: {r.artifact for r in outbox.cascade(deps, spark.createDataFrame([(r,) for r in refs], "dep_ref string")).collect()}
    assert found("f1") == {"a1", "a3", "a4"} and found("f7") == {"a6", "a7"} and found("none") == found() == set()
    assert found("f2", "a1") == {"a2", "a3", "a4"}


def test_a_failed_batch_is_told_once(spark, tmp_path):
    deps, out, check, source = (str(tmp_path / x) for x in ("deps", "out", "check", "in"))
    outbox.start(spark.createDataFrame(DEPS, outbox.DEPS), deps)
    failures = [0, 1]

    def between(number):
        if number in failures:
            failures.remove(number)
            raise RuntimeError("lost between the two writes")

    def run():
        stream = spark.readStream.schema("dep_ref string").option("maxFilesPerTrigger", 1).parquet(source)
        query = outbox.follow(stream, deps, out, check, between).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:
            return "lost between" in str(e)
        return False

    def told():
        return sorted((r.batch, *json.loads(r.payload).values()) for r in outbox.events(spark, out).collect())

    spark.createDataFrame([("f1",), ("f1",), (None,)], "dep_ref string").coalesce(1).write.parquet(source)
    assert run() and not run()
    first = [(0, "a1", ["f1"]), (0, "a3", []), (0, "a4", [])]
    assert told() == first
    spark.createDataFrame([("f1",), ("f2",)], "dep_ref string").coalesce(1).write.mode("append").parquet(source)
    assert run() and not run() and not run()
    assert told() == [*first, (1, "a2", ["f2"])]  # a4 has no dependencies since it was invalidated
    assert {r.artifact for r in outbox.dependencies(spark, deps).collect()} == {"a5", "a6", "a7"}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "deps")
    assert outbox.versions(spark, path) == [] and outbox.dependencies(spark, path).count() == 0
    outbox.start(spark.createDataFrame(DEPS, outbox.DEPS), path)
    none = spark.createDataFrame([], "dep_ref string")
    for n in range(5):
        outbox.handle(none, n, path, str(tmp_path / "out"))
    assert outbox.versions(spark, path) == [2, 3, 4] and outbox.dependencies(spark, path, before=4).count() == len(DEPS)
    assert outbox.events(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("folder", ["none"])
def test_no_events(spark, tmp_path, folder):
    assert outbox.events(spark, str(tmp_path / folder)).count() == 0
