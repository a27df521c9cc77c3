"""Greedy clusters in a given order, without one task for a block.

Leaders: a row leads if no earlier leader is similar enough.  That is the
lexicographically first independent set of the similarity graph: in each round every
row without an undecided earlier neighbour leads, and its later neighbours follow.
The result is that of going through the rows one by one; the number of rounds is that
of the longest chain of decisions, a few for orders that have nothing to do with
similarity.

Centroids: a row joins the nearest cluster whose mean is similar enough.  A mean m of k
unit vectors, each of which was within ``least`` of the mean before it, is at least
``least`` long, so a row within ``least`` of it is within ``least`` squared of one of its
members.  Rows of different components of that graph never meet: each component is gone
through in order, by a task of its own.  A component is as small as ``least`` is high;
a low limit can make one of all rows.

Rows with equal vectors are compared once.  Null and zero vectors lead themselves.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut
from .graph import components
from .similar import _matrix, cosine_links, cosine_pairs

SLACK = 1e-5


def first_independent(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """v: the nodes of edges (u, v), u earlier than v, that are not in the first independent set."""
    left = cut(edges.select("u", "v").distinct())
    followers = None
    for _ in range(most):
        if left.isEmpty():
            return followers if followers is not None else left.select("v")
        heads = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        gone = cut(left.join(heads, "u", "left_semi").select("v").distinct())
        followers = gone if followers is None else followers.unionByName(gone)
        left = cut(left.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti"))
    raise RuntimeError(f"undecided rows after {most} rounds")


def _heads(rows: DataFrame, vector: str, order: tuple[str, ...], block: str) -> tuple[DataFrame, DataFrame]:
    """(rows as block, id, x, key; of those with equal vectors the first one), settled as both are read more than once."""
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("id"))
    own = cut(rows.select(F.col(block).alias("block"), "id", F.col(vector).cast("array<double>").alias("x"), key.alias("key")))
    first = own.where("x IS NOT NULL").groupBy("block", "x").agg(F.min("key").alias("key")).select("block", F.col("key.id").alias("id"), "x", "key")
    return own, cut(first)


def _with_copies(own: DataFrame, heads: DataFrame, decided: DataFrame) -> DataFrame:
    """id, leader, similarity of all rows from those of the first of equal vectors."""
    head = heads.select("block", "x", F.col("id").alias("head")).join(decided.select(F.col("id").alias("head"), "leader", "similarity"), "head")
    out = own.join(head, ["block", "x"], "left")
    return out.select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def leaders(rows: DataFrame, least: float, vector: str = "embedding", order: tuple[str, ...] = ("id",), block: str = "block", centroid: bool = False) -> DataFrame:
    """(id, leader, similarity): greedy clusters within a block, in the order of the columns ``order``, then of the id.

    Each row joins the first (with ``centroid`` the nearest) cluster whose leader (mean) has a cosine of
    ``least`` or more, or leads its own with similarity 1.  Cosines count to six places.
    """
    own, heads = _heads(rows, vector, order, block)
    if centroid:
        return _by_centroid(own, heads, least)
    edges = cosine_pairs(heads, least, "block", "x")
    keys = heads.select("id", "key")
    both = edges.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    early = F.col("ka") < F.col("kb")
    directed = cut(both.select(F.when(early, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("v"), F.least("ka", "kb").alias("ku"), "sim"))
    followers = cut(first_independent(directed))
    joined = directed.join(followers.select(F.col("v").alias("u")), "u", "left_anti").groupBy("v").agg(F.min(F.struct("ku", "u", "sim")).alias("x"))
    decided = heads.select("id").join(joined.select(F.col("v").alias("id"), F.col("x.u").alias("leader"), F.col("x.sim").alias("similarity")), "id", "left")
    return _with_copies(own, heads, decided.select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")))


def _by_centroid(own: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    import numpy as np

    group = components(cosine_links(heads, least * least - SLACK, "block", "x")).toDF("id", "group")
    placed = heads.join(group, "id", "left").select("block", "x", F.coalesce("group", "id").alias("group"))
    kind = own.schema["id"].dataType.simpleString()
    parts = [f.name for f in own.schema["key"].dataType.fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["x", *parts])
        order = pa.table({c: table.column(c) for c in parts})
        table = table.take(pc.sort_indices(order, sort_keys=[(c, "ascending") for c in parts], null_placement="at_start"))
        v = _matrix(table.column("x"))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sums, norms, n = np.empty((64, v.shape[1])), np.empty(64), 0
        leader, similarity, head = np.empty(len(v), np.int64), np.ones(len(v)), np.empty(len(v), np.int64)
        for i, x in enumerate(v):
            sims = np.round(sums[:n] @ x / np.maximum(norms[:n], 1e-12), 6)
            k = int(np.argmax(sims)) if n else -1
            if k >= 0 and sims[k] >= least:
                sums[k] += x
                similarity[i] = sims[k]
            else:
                if n == len(sums):
                    sums, norms = np.concatenate([sums, np.empty_like(sums)]), np.concatenate([norms, np.empty_like(norms)])
                k, n = n, n + 1
                sums[k], head[k] = x, i
            norms[k] = np.linalg.norm(sums[k : k + 1], axis=1)[0]
            leader[i] = head[k]
        ids = table.column("id").combine_chunks()
        return pa.table({"id": ids, "leader": ids.take(pa.array(leader)), "similarity": similarity})

    member = own.join(placed, ["block", "x"], "left")
    alone = member.where("group IS NULL").select("id", F.col("id").alias("leader"), F.lit(1.0).alias("similarity"))
    grouped = member.where("group IS NOT NULL").select("block", "group", "id", "x", *[F.col(f"key.{c}").alias(c) for c in parts if c != "id"])
    return grouped.groupBy("block", "group").applyInArrow(run, f"id {kind}, leader {kind}, similarity double").unionByName(alone)
