"""Structured Streaming: windows with late data, duplicates, joins, and corroboration with state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """window_start, event_type, n, total; the same for batch and stream."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "7 days", step: str = "1 day", late: str | None = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """user_id, session_start, n: activity with no longer pause than the gap."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def unique(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def followed(left: DataFrame, right: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of one user where right comes after left within the time; a stream-stream join on bounded state."""
    a, b = left.select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id")), right.select(F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id"))
    if left.isStreaming:
        a, b = a.withWatermark("a_ts", late), b.withWatermark("b_ts", late)
    near = (F.col("user_id") == F.col("b_user")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "a_id", "b_id")


def noisy_or_stream(claims: DataFrame) -> DataFrame:
    """s, p, o, final_confidence, n_sources after each batch that changes a key; state: the best confidence of each source."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sources, best = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(sources, best, strict=True))
        for pdf in batches:
            for source, c in zip(pdf["source_iri"], pdf["confidence"], strict=True):
                held[source] = max(c, held.get(source, 0.0))
        state.update((list(held), list(held.values())))
        miss = 1.0
        for c in held.values():
            miss *= 1 - c
        yield pd.DataFrame({"s": [key[0]], "p": [key[1]], "o": [key[2]], "final_confidence": [round(1 - miss, 6)], "n_sources": [len(held)]})

    return claims.groupBy("s", "p", "o").applyInPandasWithState(update, "s string, p string, o string, final_confidence double, n_sources long", "sources array<string>, best array<double>", "update", GroupStateTimeout.NoTimeout)


class Hashes:
    """The last hash of each key, over batches: a folder for each batch, and now and then one for all up to a batch.

    A batch that is done again writes its own folder again.  ``compact`` makes the folder of all before it
    removes what that replaces, so a job that breaks off in between loses nothing; folders that are not whole do not count.
    """

    SCHEMA = "fragment_key string, content_hash string, at long"
    FOLDER = re.compile(r"(base|batch)=(\d+)")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self.hadoop.Path(self.path)
        return [x.getPath().getName() for x in self.fs.listStatus(root)] if self.fs.exists(root) else []

    def folders(self) -> list[tuple[int, str]]:
        """(batch, name) of what counts: the last whole base, and the batches after it."""
        named = [(m[1], int(m[2]), x) for x in self._names() if (m := self.FOLDER.fullmatch(x)) and self.fs.exists(self._at(f"{x}/_SUCCESS"))]
        base = max((n for kind, n, _ in named if kind == "base"), default=-1)
        return sorted((n, x) for kind, n, x in named if (n == base if kind == "base" else n > base))

    def read(self, before: int | None = None) -> DataFrame:
        """fragment_key, content_hash, at; of batches before one, as far as no base has taken it in."""
        names = [x for n, x in self.folders() if before is None or n < before or x.startswith("base=")]
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{x}" for x in names])

    def add(self, rows: DataFrame, number: int) -> None:
        rows.select("fragment_key", "content_hash", F.lit(number).cast("long").alias("at")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def compact(self, number: int) -> None:
        """Keep one hash a key for all batches up to this one."""
        made = f"base={number}"
        if (number, made) in self.folders():  # a batch that is done again
            return self._drop(number, made)
        last = self.read().groupBy("fragment_key").agg(F.max_by("content_hash", "at").alias("content_hash"), F.max("at").alias("at"))
        last.write.mode("overwrite").parquet(f"{self.path}/{made}")
        self._drop(number, made)

    def _drop(self, number: int, kept: str) -> None:
        for x in self._names():
            if x != kept and (m := self.FOLDER.fullmatch(x)) and int(m[2]) <= number:
                self.fs.delete(self._at(x), True)


def incremental(stream: DataFrame, fragments_path: str, checkpoint: str, compile_new, compact_every: int = 50):
    """Each batch of (fragment_key, content_hash, ...) compiles only what is new or has changed since its last hash.

    Hashes are kept with the number of their batch, of each key the last one counts; every ``compact_every`` batches only
    those are left, so a batch reads a row a key and what these batches added.
    """
    from ..operators.gate import hash_status

    def run(batch: DataFrame, number: int) -> None:
        hashes = Hashes(batch.sparkSession, fragments_path)
        prior = hashes.read(number).join(batch.select("fragment_key").distinct(), "fragment_key", "left_semi")
        status = hash_status(batch, prior).where("status <> 'unchanged'")
        fresh = cut(batch.join(status.select("fragment_key").distinct(), "fragment_key", "left_semi"))
        compile_new(fresh)
        hashes.add(fresh, number)
        if number % compact_every == compact_every - 1:
            hashes.compact(number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def server_sent_event(kind, data):
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))
