"""Views that follow a stream of changes: pages, centroids and shape scores, with retractions and expiry.

A change has a key (whose view it belongs to), an id, ``op`` (put or remove) and ``ts``.  The
state of a key is a map from id to what was put last, and what the view needs of it in
sum, so a change costs as much as the change.  Each batch that touches a key gives one row for it;
``n = 0`` retracts the view.  A key without changes for ``keep`` is given up by an event-time
timer: its state goes, and it is retracted.

A batch in which an id occurs more than once counts its last change by ``ts`` (ties: a
removal last).  Removing what is not there changes nothing.  ``*_now`` give the same rows
for a table of all changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class View(StatefulProcessor):
    """One map of items a key; ``render`` makes the view's columns. Items are JSON texts."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id string", "item string")
        self.total = handle.getValueState("total", "total string")

    def item(self, row) -> str:
        """What is kept of a change."""
        raise NotImplementedError

    def changed(self, total, old, new):
        """The sum after an item (None: none) took the place of another; items and sums are decoded."""
        return total

    def render(self, key, total) -> tuple:
        raise NotImplementedError

    def entries(self) -> Iterator[tuple[str, object]]:
        return ((k[0], json.loads(v[0])) for k, v in self.items.iterator())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        changes = pd.concat(list(rows))
        changes["_last"] = changes["op"].eq("remove")
        last = changes.sort_values(["ts", "_last"], kind="stable").drop_duplicates("id", keep="last")
        total = self.total.get()
        total = json.loads(total[0]) if total else None
        for row in last.itertuples(index=False):
            name = (str(row.id),)
            old = json.loads(self.items.getValue(name)[0]) if self.items.exists() and self.items.containsKey(name) else None
            new = None if row.op == "remove" else json.loads(self.item(row))
            if old is None and new is None:
                continue
            if new is None:
                self.items.removeKey(name)
            else:
                self.items.updateValue(name, (json.dumps(new),))
            total = self.changed(total, old, new)
        if total is not None:
            self.total.update((json.dumps(total),))
        if self.keep_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            newest = int(changes["ts"].max().timestamp() * 1000)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield self.rows(key, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.items.clear()
        self.total.clear()
        yield self.rows(key, None)

    def rows(self, key, total) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *self.render(key, total))], columns=self.columns)

    def close(self) -> None:
        pass


class Pages(View):
    """Facts of a subject as a page: one line for each predicate, its objects by falling confidence."""

    columns = ["key", "n", "page"]

    def item(self, row) -> str:
        return json.dumps([row.p, row.o, round(float(row.confidence), 6)])

    def changed(self, total, old, new):
        return (total or 0) + (new is not None) - (old is not None)

    def render(self, key, total):
        facts = sorted((v for _, v in self.entries()), key=lambda v: (v[0], -v[2], v[1])) if total else []
        lines: dict[str, list[str]] = {}
        for p, o, _ in facts:
            lines.setdefault(p, []).append(o)
        return len(facts), "\n".join(f"{p}: {', '.join(os)}" for p, os in lines.items())


class Centroids(View):
    """The mean vector of a cluster's members, from their sum."""

    columns = ["key", "n", "centroid"]

    def item(self, row) -> str:
        return json.dumps([float(x) for x in row.v])

    def changed(self, total, old, new):
        n, sums = total or (0, [0.0] * len(new or old))
        for x, sign in ((old, -1), (new, 1)):
            if x is not None:
                n, sums = n + sign, [a + sign * b for a, b in zip(sums, x, strict=True)]
        return [n, sums if n else [0.0] * len(sums)]  # what rounding left goes with the last member

    def render(self, key, total):
        n, sums = total or (0, [])
        return n, [round(x / n, 6) for x in sums] if n else []


class Scores(View):
    """1 - the share of a graph's focus nodes that violate a shape; a node's change says how many shapes it violates."""

    columns = ["key", "n", "n_bad", "score"]

    def item(self, row) -> str:
        return json.dumps(int(row.n_violations))

    def changed(self, total, old, new):
        n, bad = total or (0, 0)
        return [n + (new is not None) - (old is not None), bad + bool(new) - bool(old)]

    def render(self, key, total):
        n, bad = total or (0, 0)
        return n, bad, round(1 - bad / n, 6) if n else None


SCHEMAS = {Pages: "key string, n long, page string", Centroids: "key string, n long, centroid array<double>", Scores: "key string, n long, n_bad long, score double"}


def follow(changes: DataFrame, view: type[View], late: str = "1 hour", keep: str | None = None) -> DataFrame:
    """The view's rows as a stream in update mode; ``keep``: how long a key lives without changes, such as "7 days"."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keep_ms = None if keep is None else int(spark.sql(f"SELECT 1000 * (unix_timestamp(TIMESTAMP '2000-01-01' + INTERVAL {keep}) - unix_timestamp(TIMESTAMP '2000-01-01'))").first()[0])
    rows = changes.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(view(keep_ms), SCHEMAS[view], "Update", "None" if keep is None else "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """What has been put and not removed: the last change of each (key, id)."""
    last = Window.partitionBy("key", "id").orderBy(F.desc("ts"), F.when(F.col("op") == "remove", 0).otherwise(1))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1 AND op <> 'remove'").drop("_n")


def pages_now(changes: DataFrame) -> DataFrame:
    facts = standing(changes).select("key", "p", "o", F.round(F.col("confidence").cast("double"), 6).alias("c"))
    lines = facts.groupBy("key", "p").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "o"))).alias("os"), F.count("*").alias("m"))
    line = F.concat("p", F.lit(": "), F.array_join(F.transform("os", lambda x: x["o"]), ", "))
    return lines.groupBy("key").agg(F.sum("m").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))), lambda x: x["line"]), "\n").alias("page"))


def centroids_now(changes: DataFrame) -> DataFrame:
    parts = standing(changes).select("key", F.posexplode("v").alias("i", "x")).groupBy("key", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"), F.count("*").alias("n"))
    return parts.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def scores_now(changes: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("n_violations") > 0)
    return standing(changes).groupBy("key").agg(F.count("*").alias("n"), bad.alias("n_bad"), F.round(1 - bad / F.count("*"), 6).alias("score"))
