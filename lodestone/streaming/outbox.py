"""Invalidation events of a stream of changes, each batch exactly once, and what depends on what after each batch.

A batch brings references that have changed.  The artifacts that depend on one are
invalidated, and so are those that depend on these, to the fixpoint; their own
dependencies go, as they are compiled anew.  All that a batch writes is named by its
number: events in ``batch=<n>`` of the outbox, dependencies in ``version=<n>`` of theirs, from the
last version below n.  So a batch that is repeated after a failure reads what it
read before and replaces what it wrote.  Old versions are removed but the last ``kept``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import fixpoint
from ..plans.lineage import cut, remove

DEPS = "artifact string, dep_kind string, dep_ref string"
EVENTS = "event_type string, payload string, batch long"


def cascade(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """artifact: what depends on a changed reference (dep_ref), directly or through other artifacts."""
    pairs = deps.where("artifact IS NOT NULL AND dep_ref IS NOT NULL").select("artifact", "dep_ref").distinct()
    first = pairs.join(changed.select("dep_ref").distinct(), "dep_ref", "left_semi").select("artifact")
    step = lambda known, new: pairs.join(new.select(F.col("artifact").alias("dep_ref")), "dep_ref", "left_semi")
    return fixpoint(first, step, ["artifact"])


def versions(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """The numbers of the complete parts below a path."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s.getPath() for s in system.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(name + "=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def dependencies(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last complete version, or the last below ``before``; none: empty."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(DEPS).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], DEPS)


def start(deps: DataFrame, path: str) -> None:
    """The dependencies before the first batch."""
    deps.select("artifact", "dep_kind", "dep_ref").write.mode("overwrite").parquet(f"{path}/version=-1")


def events(spark: SparkSession, outbox: str) -> DataFrame:
    known = versions(spark, outbox, "batch")
    return spark.read.schema(EVENTS).option("basePath", outbox).parquet(*[f"{outbox}/batch={n}" for n in known]) if known else spark.createDataFrame([], EVENTS)


def handle(batch: DataFrame, number: int, deps_path: str, outbox: str, kept: int = 3, between: Callable[[int], None] | None = None) -> None:
    """One batch of (dep_ref, ...): its events, then the dependencies that are left."""
    spark = batch.sparkSession
    deps = dependencies(spark, deps_path, before=number)
    changed = cut(batch.where("dep_ref IS NOT NULL").select("dep_ref").distinct())
    gone = cascade(deps, changed)
    direct = deps.join(changed, "dep_ref", "left_semi").groupBy("artifact").agg(F.array_sort(F.collect_set("dep_ref")).alias("because"))  # of one batch
    payload = F.to_json(F.struct("artifact", F.coalesce("because", F.array().cast("array<string>")).alias("because")))
    told = gone.join(direct, "artifact", "left").select(F.lit("artifact_invalidated").alias("event_type"), payload.alias("payload"))
    told.write.mode("overwrite").parquet(f"{outbox}/batch={number}")
    if between:
        between(number)
    deps.join(gone, "artifact", "left_anti").write.mode("overwrite").parquet(f"{deps_path}/version={number}")
    for old in versions(spark, deps_path)[:-kept]:
        remove(spark, f"{deps_path}/version={old}")


def follow(changes: DataFrame, deps_path: str, outbox: str, checkpoint: str, between: Callable[[int], None] | None = None):
    """A writer for the stream of changes; start it with the trigger that is wanted."""
    return changes.writeStream.foreachBatch(lambda batch, number: handle(batch, number, deps_path, outbox, between=between)).option("checkpointLocation", checkpoint)
