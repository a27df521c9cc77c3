"""The quads table: Parquet by graph, keyed writes, clears, counts; and the tables around it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import QUADS

KEY = ["graph", "s", "p", "o"]


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert: one quad a key, with the higher confidence."""
    rows = old.unionByName(new.select(*old.columns))
    return rows.groupBy(*KEY).agg(F.max_by("o_kind", "confidence").alias("o_kind"), F.max("confidence").alias("confidence")).select("graph", "s", "p", "o", "o_kind", "confidence")


class Store:
    """Quads under a path: a folder for each version and graph, and numbered files that name the version of each graph.

    A write makes a new version and then the next numbered file, which fails if another write made it
    first: it then starts from that write's state, and only does its work again if that changed graphs
    that it read.  A reader sees the graphs before or after a write, and a job that breaks off, or a task
    that is done again, finds all that it reads.  What is written is worked out once, before it is merged.
    ``vacuum`` removes what no graph uses any more.
    """

    CURRENT = re.compile(r"current-(\d{12})\.json")
    ATTEMPTS = 100

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = lambda name: hadoop.Path(f"{self.path}/{name}")
        return hadoop, at, at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        _, at, fs = self._files()
        return [x.getPath().getName() for x in fs.listStatus(at(""))] if fs.exists(at("")) else []

    def snapshot(self) -> tuple[int, dict[str, str]]:
        """The number of the last write, and graph -> version as it left them."""
        numbers = [int(m[1]) for x in self._names() if (m := self.CURRENT.fullmatch(x))]
        if not numbers:
            return 0, {}
        lines = self.spark.read.text(f"{self.path}/current-{max(numbers):012d}.json").collect()  # one line, a handful of graphs
        return max(numbers), json.loads("".join(r[0] for r in lines) or "{}")

    def versions(self) -> dict[str, str]:
        """graph -> version."""
        return self.snapshot()[1]

    def _commit(self, number: int, versions: dict[str, str]) -> bool:
        """Whether this became the write of that number; it does not if there is one."""
        hadoop, at, fs = self._files()
        draft, target = at(f"draft-{uuid.uuid4().hex}"), at(f"current-{number:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        kind = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, how)
        except Py4JJavaError:
            fs.delete(draft, False)
            if fs.exists(target):
                return False
            raise
        return True

    def _change(self, of: Callable[[dict[str, str]], dict[str, str]]) -> None:
        """Make ``of`` (the graphs' versions) the current ones; where another write came first, from its state again."""
        for _ in range(self.ATTEMPTS):
            number, now = self.snapshot()
            if self._commit(number + 1, of(now)):
                return
        raise RuntimeError(f"{self.path}: other writes came first {self.ATTEMPTS} times")

    def _at(self, now: dict[str, str]) -> DataFrame:
        if not now:
            return self.spark.createDataFrame([], QUADS)
        folders = [f"{self.path}/version={v}" for v in sorted(set(now.values()))]
        df = self.spark.read.option("basePath", self.path).schema(f"{QUADS.toDDL()}, version STRING").parquet(*folders)
        current = reduce(lambda a, b: a | b, [(F.col("graph") == g) & (F.col("version") == v) for g, v in sorted(now.items())])
        return df.where(current).drop("version").select(*QUADS.names)

    def read(self, graph: str | None = None) -> DataFrame:
        now = self.versions()
        if graph is None:
            return self._at(now)
        return self._at({g: v for g, v in now.items() if g == graph}).where(F.col("graph") == graph)

    def _version(self, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.select(*QUADS.names).write.partitionBy("graph").parquet(f"{self.path}/version={version}")
        return version

    def load(self, quads: DataFrame) -> None:
        """Upsert; only graphs that the new quads name are written."""
        _, at, fs = self._files()
        name, made = f"incoming-{uuid.uuid4().hex}", None
        try:
            quads.select(*QUADS.names).write.parquet(f"{self.path}/{name}")
            new = self.spark.read.schema(QUADS).parquet(f"{self.path}/{name}")
            graphs = [r[0] for r in new.select("graph").distinct().collect()]  # a handful

            def of(now: dict[str, str]) -> dict[str, str]:
                nonlocal made
                mine = {g: v for g, v in now.items() if g in graphs}
                if made is None or made[0] != mine:
                    made = mine, self._version(merged(self._at(mine), new))
                return now | dict.fromkeys(graphs, made[1])

            if graphs:
                self._change(of)
        finally:
            fs.delete(at(name), True)

    def load_json(self, records: DataFrame, column: str = "value") -> None:
        self.load(records.select(F.from_json(column, QUADS).alias("r")).select("r.*"))

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """change(all quads), and no others, from now on; worked out again if another write came first."""

        def of(now: dict[str, str]) -> dict[str, str]:
            version = self._version(merged(self.spark.createDataFrame([], QUADS), change(self._at(now))))
            written = self.spark.read.option("basePath", f"{self.path}/version={version}").schema(QUADS).parquet(f"{self.path}/version={version}")
            return {r[0]: version for r in written.select("graph").distinct().collect()}  # a handful

        self._change(of)

    def replace(self, quads: DataFrame) -> None:
        """These quads, and no others, from now on; what other writes did meanwhile goes."""
        self.rewrite(lambda _: quads)

    def clear(self, graph: str) -> None:
        self._change(lambda now: {g: v for g, v in now.items() if g != graph})

    def vacuum(self) -> None:
        """Remove versions that no graph uses and the names of earlier states; not while others read or write."""
        _, at, fs = self._files()
        number, now = self.snapshot()
        for name in self._names():
            old = (m := self.CURRENT.fullmatch(name)) and int(m[1]) < number
            if old or name.startswith(("draft-", "incoming-")) or (name.startswith("version=") and name[8:] not in now.values()):
                fs.delete(at(name), True)

    def count(self, graph: str | None = None) -> int:
        return self.read(graph).count()

    def remote(self, path: str, graph: str, weight: float = 0.8, limit: int | None = None) -> DataFrame:
        """Quads of another store's graph, with the weight as their confidence."""
        df = Store(self.spark, path).read(graph).withColumn("confidence", F.lit(weight))
        return df.limit(limit) if limit else df


def append_log(df: DataFrame, path: str) -> None:
    """ts, operation, subject, payload; only ever appended."""
    df.select("ts", "operation", "subject", "payload").write.mode("append").json(path)


def emit(events: DataFrame, path: str) -> None:
    """Outbox events: event_type and JSON payload."""
    events.select("event_type", "payload").write.mode("append").json(path)
