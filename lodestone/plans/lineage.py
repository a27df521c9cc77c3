"""What keeps long jobs safe and even: lineage cut in the shared folder, joins that a hot key does not slow down."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

HOT_KEYS = 1024
LEAST_HOT = 1000
FEW_ROWS = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"  # both ends hold a batch, outside the heap
WRITE = {CLEANUP: "true", BATCH: "8m"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set and all runs on one machine, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not context.isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
    spark.sparkContext.setCheckpointDir(found)
    return found


class Scope:
    """What ``settled`` has stored so far, and the most files of a table."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.files: int | None = None


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], kept: list[str] | None = None) -> DataFrame:
    """make(), which ends with ``table``: of all that was stored meanwhile, only that last table stays on disk. ``kept`` gets its path."""
    scope, outer, done = Scope(), _scope.get(), False
    token = _scope.set(scope)
    try:
        out = make()
        done = True
        return out
    finally:
        _scope.reset(token)
        if done:
            path = scope.paths.pop()
            for known in (kept, outer and outer.paths):
                if known is not None:
                    known.append(path)
        for path in scope.paths:
            remove(spark, path)


def few(df: DataFrame, files: int) -> DataFrame:
    """df in so many partitions at most, but one for each core: a small table in many files costs more for files than for rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, files))


def few_files(files: int) -> None:
    """From here on, what is stored within ``settled`` goes into so many files at most."""
    if scope := _scope.get():
        scope.files = files


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; lost executors then cost no recomputation.

    With about so many ``rows``, no partition is made for fewer than FEW_ROWS of them.
    """
    spark = df.sparkSession
    df = df if rows is None else few(df, 1 + rows // FEW_ROWS)
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as Parquet: column reads are pruned, and the file is smaller than a checkpoint.

    What the write shuffled goes as soon as it ends, as nothing reads it again.  Rows go to Python a few MB at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scope := _scope.get():
        scope.paths.append(path)
        df = few(df, scope.files) if scope.files else df
    before = {k: spark.conf.get(k) for k in WRITE}
    for k, v in WRITE.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what stored tables were made from: Spark's cleaner removes shuffle files once the driver has collected their plans.

    Without it that waits for the driver's next full collection, up to ``spark.cleaner.periodicGC.interval``.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def hot_join(many: DataFrame, one: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """many INNER JOIN one USING (key); ``one`` has each key once and, in column ``count``, the rows of ``many`` with it, ``total`` in all.

    Keys with more than total / HOT_KEYS rows (LEAST_HOT at least) are HOT_KEYS at most, so they can be
    broadcast however large the input is, and their rows stay where they are.  Only the others are shuffled.
    """
    if total <= LEAST_HOT:
        return many.join(one, key)
    limit = max(LEAST_HOT, total // HOT_KEYS)
    hot = F.broadcast(one.where(F.col(count) > limit))
    rest = many.join(F.broadcast(one.where(F.col(count) > limit).select(key)), key, "left_anti")
    return many.join(hot, key).unionByName(rest.join(one.where(F.col(count) <= limit), key))


def parts(df: DataFrame, rows: int, each: int) -> int:
    """So many partitions that one gets about ``each`` of so many ``rows``, but the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // each)


def spread(df: DataFrame, by: str, each: int = 20_000) -> DataFrame:
    """df in partitions of about ``each`` rows: a small file is one task, however much is to be done for each row."""
    return df.repartition(parts(df, df.count(), each), by)


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with ``name``: 1, 2, ... in that order, counted within sorted ranges, so that no task has all rows."""
    rows = cut(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    n = dict(rows.groupBy(part).count().collect())  # a row for each range
    before = {p: sum(c for q, c in n.items() if q < p) for p in n}
    if not n:
        return rows.withColumn(name, F.lit(0)).drop("_id")
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[part]
    return rows.withColumn(name, start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id")
