"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed to 63 bits.  ``tally`` tells of
each value how many sets have it, as a class (floor(log2(count))), without a broadcast.

Two sketches come from the one hash function:

* ``kept``, for the inverted lists: the bottom k = n - ceil(s * n) + 1 of a set of n in
  the order of (class, hash).  Whatever the order, two sets of similarity s share a
  value that both keep, the first of their common ones; so the lists lose no link,
  where a k of one fixed size would lose some.  Values that no other set has come first
  and need no posting; passages that many documents share come last.  A set with k
  values of its own or more is similar to no other.
* ``low``, for estimates: the ``LOW`` smallest hashes.  The smallest of two such sketches
  together are a sample of the union; pairs of which it shows too few common values go.
  The bound lies so low (``floor_of``) that a true pair falls below it with a chance of
  1e-12; a union that fits in the sketch is judged exactly.

1. Equal sets are one class (128-bit fingerprint); its smallest id stands for it.
2. Stars: in the lists of each class's three smallest shared values every class is
   compared with the one that has the least of its own.  This gathers large groups
   of near copies by as many comparisons as they have members.
3. Lists of usual values (class below ``HOT``, so of fewer than 2 ** HOT sets): pairs of
   classes of different components.
4. Lists of hot values.  A pair found only there shares hot values alone, since others
   would come first.  Classes with equal sets of hot values have equal overlaps with any
   other, so the smallest of them, their head, is similar to whatever one of them is
   similar to, and linked to that one.  It is enough to compare each class with its
   head, and with the heads in its lists that are of other components.
5. Verification compares full sets.  Their hashes travel once to each pair's lesser end
   and once to every share of the pairs of the other end.

Components of all verified links and classes follow.  Hot keys are joined by ``hot_join``.

Empty and null texts have empty sets and link with nothing.  A null id links with
nothing and is kept.  Rows with the same id are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import few_files, hot_join, settled, table
from .blobs import packed, unpacked
from .graph import components
from .tally import Cells, Classes, counted
from .text import U64, Words, chunks, mix, rolling
from .wordblocks import BLOCK, PAYLOAD, Block, blocks

SHINGLE, PERCENT = 5, 80
STARS = 3
LOW = 64
HOT = 8
SHARE = 256  # pairs of one document that a task compares together
_S = 0xD1342543DE82EF95 | 1
SKETCH = (
    "doc_id long, missing boolean, n long, r long, fp binary, stars array<long>, kept array<long>, usual int, hot int, signature long, low array<long>"
)


def shingle_sets(word: np.ndarray, count: np.ndarray, first: np.ndarray, whole: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indptr, hashes): each row's distinct shingles, ascending; with fewer than k words, all of them as one.

    ``word``: hashes; ``count`` and ``first``: words of each row and the first one; ``whole``: first words of its windows of k.
    """
    doc = np.repeat(np.arange(len(count)), count)[whole]
    h = mix(rolling(word, k, _S)[whole]) if len(whole) else np.empty(0, U64)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.concatenate([h, mix(rolling(word, n, _S)[first[short]] + U64(n))])
            doc = np.concatenate([doc, short])
    h = h >> U64(1)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return np.searchsorted(doc, np.arange(len(count) + 1)), h


def sets_of(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(b.word, b.count, b.first, b.whole_windows(k), k)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def sketched(b: Block, group: pa.Table, cells: Cells, k: int, percent: int, hot_class: int) -> pa.Table:
    """The rows of one block as SKETCH: r values that others may have; the first ``usual`` of kept are of usual classes; ``hot`` values of the set are hot."""
    indptr, h = sets_of(b, k)
    cls = Classes(group, cells).of(h)
    rows = len(b.ids)
    n = np.diff(indptr)
    doc = np.repeat(np.arange(rows), n)
    fp = [xxhash.xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(indptr[:-1].tolist(), indptr[1:].tolist(), strict=True)]
    shared = cls > 0
    r = np.bincount(doc[shared], minlength=rows)
    size = np.clip(r - (percent * n + 99) // 100 + 1, 0, r)  # of kept, without the n - r values of its own
    place = np.arange(len(h)) - indptr[:-1][doc]
    low = (place < LOW) & (size[doc] > 0)
    hot = (cls >= hot_class) & (size[doc] > 0)
    n_hot = np.bincount(doc[hot], minlength=rows)
    signature = np.zeros(rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(n_hot)])
    values = h[hot]
    for i in np.flatnonzero(n_hot).tolist():
        signature[i] = xxhash.xxh3_64_intdigest(values[begin[i] : begin[i + 1]].tobytes()) >> 1
    shared &= size[doc] > 0
    own, own_doc, own_cls = h[shared], doc[shared], cls[shared]
    first = np.searchsorted(own_doc, np.arange(rows))
    rank = np.arange(len(own)) - first[own_doc]
    order = np.lexsort((own, own_cls, own_doc))
    chosen = order[rank < size[own_doc]]
    usual = np.bincount(own_doc[chosen][own_cls[chosen] < hot_class], minlength=rows)
    return pa.table({
        "doc_id": pa.array(b.ids, pa.int64()), "missing": pa.array(b.null), "n": pa.array(n, pa.int64()), "r": pa.array(r, pa.int64()),
        "fp": pa.array(fp, pa.binary()), "stars": lists(own[rank < STARS], np.where(size > 0, np.minimum(r, STARS), 0)), "kept": lists(own[chosen], size),
        "usual": pa.array(usual, pa.int32()), "hot": pa.array(n_hot, pa.int32()), "signature": pa.array(signature, pa.int64()),
        "low": lists(h[low], np.bincount(doc[low], minlength=rows)),
    })


def sketches(docs: DataFrame, k: int, percent: int, hot_class: int = HOT, block: int = BLOCK) -> DataFrame:
    """A row of SKETCH for each document, written to the shared folder."""
    own = blocks(docs, lower=True, size=block)
    n_words = own.agg(F.sum("n_words")).first()[0] or 0
    few_files(1 + n_words // block)
    cells = Cells(n_words)
    told = counted(own.select("block", *PAYLOAD), lambda *payload: sets_of(Block(*payload), k)[1], cells)

    def meet(key, left, right):
        return sketched(Block(*(left.column(c)[0].as_py() for c in PAYLOAD)), right, cells, k, percent, hot_class)

    return table(own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(meet, SKETCH), "sketches")


def need(n: Column, m: Column, percent: int) -> Column:
    """How many values similar sets of n and m values have in common at least."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def reachable(n: Column, r: Column, m: Column, q: Column, percent: int) -> Column:
    """Whether sets of n and m values, of which others may have r and q, can be similar enough."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(r, q) >= need(n, m, percent))


def floor_of(percent: int, size: int = LOW, nats: float = 28.0) -> int:
    """The most common values that a sample of ``size`` from a union can fall short of with a chance below exp(-nats), by Chernoff's bound."""
    p = percent / 100

    def divergence(x: float) -> float:
        return (x * math.log(x / p) if x else 0) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 < 1 / p else 0)

    return max((t for t in range(size) if t / size < p and size * divergence(t / size) >= nats), default=0)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """The union-sketch estimate, from two columns of LOW smallest values."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, LOW)
    common = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(union, -1)))
    return F.when(F.size(union) < LOW, 100 * common >= percent * F.size(union)).otherwise(common >= floor_of(percent))


def star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    values = classes.select(F.explode("stars").alias("value"), "doc_id", "n", "r")
    hub = F.min(F.struct((F.col("n") - F.col("r")).alias("own"), F.col("doc_id").alias("hub"), F.col("n").alias("m"), F.col("r").alias("q"))).alias("x")
    first = table(values.groupBy("value").agg(hub, F.count("*").alias("c")).where("c > 1").select("value", "x.hub", "x.m", "x.q", "c"), "hubs")
    total = first.agg(F.sum("c")).first()[0] or 0
    both = hot_join(values, first, "value", "c", total)
    return ordered(both.where((F.col("doc_id") != F.col("hub")) & reachable(*map(F.col, "nrmq"), percent)), "doc_id", "hub")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


POSTING = ("value", "id", "n", "r", "comp", "rank")


def postings(classes: DataFrame) -> DataFrame:
    """POSTING, whether the value is of a usual class, and of the set: hot, signature."""
    at = classes.select(F.posexplode("kept").alias("pos", "value"), F.col("doc_id").alias("id"), "n", "r", "comp", "usual", "hot", "signature")
    return at.select(*POSTING[:-1], (F.col("n") - F.col("r") + F.col("pos")).alias("rank"), (F.col("pos") < F.col("usual")).alias("is_usual"), "hot", "signature")


def early(x: str, y: str, percent: int) -> Column:
    """A pair shares a value among the first n - need + 1 of both sets; whether this is such a place, and the sizes allow the similarity."""
    least = need(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)
    near = reachable(F.col(f"{x}.n"), F.col(f"{x}.r"), F.col(f"{y}.n"), F.col(f"{y}.r"), percent)
    return near & (F.col(f"{x}.n") - F.col(f"{x}.rank") >= least) & (F.col(f"{y}.n") - F.col(f"{y}.rank") >= least)


def usual_pairs(all_postings: DataFrame, percent: int) -> DataFrame:
    own = all_postings.where("is_usual").select(*POSTING)
    mixed = own.groupBy("value").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("value")
    own = table(own.join(mixed, "value", "left_semi"), "mixed")
    both = own.alias("x").join(own.alias("y").hint("merge"), (F.col("x.value") == F.col("y.value")) & (F.col("x.comp") < F.col("y.comp")) & early("x", "y", percent))
    return ordered(both, "x.id", "y.id")


def hot_pairs(all_postings: DataFrame, percent: int) -> DataFrame:
    """Classes with the heads of classes that have the same hot values, and with the heads of other components in their lists."""
    own = table(all_postings.where("NOT is_usual").drop("is_usual"), "hot")
    members = own.select("signature", "id", "n", "hot", "comp").distinct()
    head = F.min(F.struct(F.col("n").alias("m"), F.col("id").alias("head"), F.col("comp").alias("head_comp"))).alias("x")
    heads = table(members.groupBy("signature").agg(head, F.count("*").alias("c")).select("signature", "x.*", "c"), "heads")
    n_members = heads.agg(F.sum("c")).first()[0] or 0
    if not n_members:
        return own.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    beside = hot_join(members, heads, "signature", "c", n_members)
    beside = beside.where((F.col("id") != F.col("head")) & (F.col("comp") != F.col("head_comp")) & (F.col("hot") >= need(F.col("n"), F.col("m"), percent)))
    # In a list, most rows are of one component; only the others have anybody to meet.
    sizes = own.groupBy("value", "comp").agg(F.count("*").alias("k"))
    lists_ = table(sizes.groupBy("value").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("c"), F.count("*").alias("comps")).where("comps > 1").drop("comps"), "lists")
    total = lists_.agg(F.sum("c")).first()[0] or 0
    rows = hot_join(own, lists_, "value", "c", total).join(heads.select(F.col("head").alias("id"), F.lit(True).alias("leads")), "id", "left")
    rows = table(rows.withColumn("shares", (1 + F.floor(F.col("c") / SHARE)).cast("int")).drop("c"), "lists")
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    everywhere = rows.where("leads").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        overlap = F.least("x.hot", "y.hot") >= need(F.col("x.n"), F.col("y.n"), percent)
        other = (F.col("x.value") == F.col("y.value")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.comp") != F.col("y.comp"))
        # The optimizer sees the stored rows, not how many shares they are copied to, and would send all copies through the driver.
        return ordered(x.alias("x").join(y.alias("y").hint("merge"), other & overlap & early("x", "y", percent)), "x.id", "y.id")

    found = meet(dealt.where("comp <> main"), everywhere).unionByName(meet(dealt.where("comp = main"), everywhere.where("comp <> main")))
    return ordered(beside, "id", "head").unionByName(found)


def bodies(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, body: the sets of the documents of these ids, which differ.

    The ids never meet in one place, however many they are: texts go to them, and are not sorted there.
    """
    wanted = ids.hint("shuffle_hash")

    def run(batches):
        for chunk in chunks(batches):
            w = Words(chunk)
            at = np.flatnonzero(np.arange(len(w.start)) + k <= w.first[1:][w.doc])
            indptr, h = shingle_sets(w.hashes(), w.count, w.first, at, k)
            out = [packed(h[x:y], delta=1) for x, y in zip(indptr[:-1].tolist(), indptr[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(out, pa.binary())], names=["id", "body"])

    return table(docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(run, "id long, body binary"), "bodies")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough, written to the shared folder."""
    pairs = table(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("c"))
    ends = table(ends.join(classes.select("doc_id", "low"), "doc_id"), "ends")
    total = 2 * pairs.count()
    end = lambda x: ends.select(F.col("doc_id").alias(x), F.col("low").alias(f"{x}_low"), F.col("c").alias(f"{x}_c"))
    both = hot_join(hot_join(pairs, end("u"), "u", "u_c", total), end("v"), "v", "v_c", total)
    more = F.col("u_c") >= F.col("v_c")
    likely = both.where(may_be_similar("u_low", "v_low", percent)).select(
        F.when(more, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("id"),
        (1 + F.floor(F.greatest("u_c", "v_c") / SHARE)).cast("int").alias("shares"),
    )
    likely = table(likely, "likely")
    found = bodies(docs, likely.select(F.explode(F.array("hub", "id")).alias("id")).distinct(), k)
    lesser = likely.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).join(found, "id").select("hub", "share", "id", "body")
    hubs = likely.select(F.col("hub").alias("id"), "shares").distinct().join(found, "id")
    hubs = hubs.select(F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("id"), "body")
    dealt = hubs.unionByName(lesser).repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("id").asc_nulls_first())

    def compare(batches):
        at, own = None, []
        for batch in batches:
            good = []
            for hub, share, member, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if member is None:
                    own = own if at == (hub, share) else []
                    at = hub, share
                    own.append(unpacked(body)[0])
                    good.append(False)
                    continue
                b = unpacked(body)[0]
                common = [len(np.intersect1d(a, b, assume_unique=True)) for a in own]
                good.append(any(100 * c >= percent * (len(a) + len(b) - c) for a, c in zip(own, common, strict=True)))
            yield batch.filter(pa.array(good, pa.bool_())).select(["hub", "id"]).rename_columns(["u", "v"])

    return table(dealt.mapInArrow(compare, "u long, v long"), "links")


def groups(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, hot_class: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept: one row per row of documents.

    Of all that is stored for it, only the result stays in the shared folder.
    """
    docs = documents.select("doc_id", "text")
    out = settled(documents.sparkSession, lambda: table(labelled_rows(docs, k, percent, hot_class), "groups"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def labelled_rows(docs: DataFrame, k: int, percent: int, hot_class: int) -> DataFrame:
    """doc_id, n_shingles, component_id, from tables in the shared folder."""
    found = sketches(docs, k, percent, hot_class)
    full = found.where("n > 0 AND NOT missing")
    first = table(full.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "classes")
    n_full = first.agg(F.sum("c")).first()[0] or 0
    # Rows with one id but different texts tie their classes together.
    twice = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    ties = full.join(twice, "doc_id", "left_semi").select("doc_id", "fp").join(first, "fp").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    some = full.where("size(kept) > 0").join(first.select("fp", F.col("first").alias("doc_id")), ["fp", "doc_id"], "left_semi")
    some = table(some.drop("fp", "missing"), "classes")
    stars = verified(star_pairs(some, percent), some, docs, k, percent)
    known = components(stars.unionByName(ties))
    labelled = some.drop("stars", "low").join(known.withColumnsRenamed({"node": "doc_id", "component": "comp"}), "doc_id", "left")
    lists_ = table(postings(labelled.withColumn("comp", F.coalesce("comp", "doc_id"))), "postings")
    links = verified(usual_pairs(lists_, percent).unionByName(hot_pairs(lists_, percent)).distinct(), some, docs, k, percent)
    label = components(stars.unionByName(ties).unionByName(links)).withColumnRenamed("node", "first")
    of_class = table(first.join(label, "first", "left").select("fp", "c", F.coalesce("component", "first").alias("component_id")), "labels")
    linked = hot_join(full.select("doc_id", "n", "fp"), of_class, "fp", "c", n_full).select("doc_id", "n", "component_id")
    id_ = F.when(~F.col("missing"), F.col("doc_id"))
    alone = found.where("n = 0 OR missing").select(id_.alias("doc_id"), "n", id_.alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles").select("doc_id", "n_shingles", "component_id")
