"""Similarity joins that lose no pair: a metric index for cosines, a gram index for edit ratios.

Cosine: angles between unit vectors are a metric.  Rows belong to the nearest of some
pivots; two rows within an angle of each other lie in one cell, or the one of the
higher cell is so close to the lower cell's border that it is sent there as a guest.
In a cell, the distances to all pivots bound the angle from below before any
product is formed, where a look at some rows says that this pays.  Cells are cut into
tiles, mostly so many in each, so that what is sent grows with the rows.
Where vectors are spread evenly in many dimensions and the limit is low, no bound
prunes, and what is left is all pairs by tiles.

Edit ratio (2 * matched characters / both lengths): names with that ratio share a
least number of q-grams, so they share one of the few rarest of each (a prefix of
its grams by rarity), at places not further apart than the edits allow.

Rows with the same vector, or name, are joined once (``distinct``) and meet again by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import ratio_of
from ..plans.lineage import cut

PIVOTS = 32
TILE = 32_768  # rows on either side of a tile at most
PARTS = 16  # tiles of a cell, unless these were larger than TILE or smaller than LEAST_TILE
LEAST_TILE = 256
PRODUCTS = 1 << 20  # at once
HELD = 1 << 18  # pairs before they leave a task
SLACK = 1e-6  # radians, for rounding


def _units(vectors):
    import numpy as np

    v = np.array([np.asarray(x, float) for x in vectors]) if len(vectors) else np.zeros((0, 1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def pivots_of(rows: DataFrame, reach: float, n: int = PIVOTS, sample: int = 2048) -> list[list[float]]:
    """n vectors far from each other, from at most ``sample`` rows (those with the least hashes of their vector).

    One, so that all rows are in one cell, where most rows of the sample would be guests in most cells.
    """
    import numpy as np

    found = [r[0] for r in rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(sample).collect()]
    if not found:
        return []
    v = _units(found)
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(n, len(v)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, v @ v[k])
    dist = np.arccos(np.clip(v @ v[chosen].T, -1, 1))
    member = (dist <= dist.min(1, keepdims=True) + 2 * reach).sum()
    return v[chosen if member * 2 <= member.dtype.type(dist.size) else chosen[:1]].tolist()


def _matrix(column):
    """A column of vectors of one length as an array of doubles."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _unit_rows(v):
    import numpy as np

    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def placed(rows: DataFrame, reach: float, pivots: list[list[float]]) -> DataFrame:
    """rows (with x) with home, cell: each row in its own cell and, as a guest, in lower ones that it can have partners in."""
    import numpy as np

    if len(pivots) == 1:
        return rows.withColumns({"home": F.lit(0), "cell": F.lit(0)})
    points, x_at = np.array(pivots), rows.columns.index("x")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            dist = np.arccos(np.clip(_unit_rows(_matrix(batch.column(x_at))) @ points.T, -1, 1))
            home = dist.argmin(1)
            own = dist[np.arange(len(dist)), home]
            member = (dist <= own[:, None] + 2 * reach) & (np.arange(len(points)) < home[:, None])
            member[np.arange(len(dist)), home] = True
            row, cell = np.nonzero(member)
            take = pa.array(row)
            columns = [c.take(take) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(home[row].astype(np.int32)), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "home", "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, home int, cell int")


def _dealt(cells: DataFrame, size: int) -> DataFrame:
    """Rows in all the tiles that they take part in: two of a cell's own rows, or one of these and one of guests (two guests meet elsewhere).

    A cell has PARTS tiles unless it is small, or too large for that: each row is sent so many times, however many rows there are.
    """
    own = F.col("home") == F.col("cell")
    count = lambda what: F.count(F.when(what, 1))
    part = lambda what: F.greatest(F.ceil(count(what) / size), F.least(F.lit(PARTS), F.ceil(count(what) / LEAST_TILE))).cast("int")
    n = cells.groupBy("block", "cell").agg(part(own).alias("n"), part(~own).alias("g"))  # a row for each cell
    place = F.when(own, F.pmod(F.xxhash64("id"), F.col("n"))).otherwise(F.col("n") + F.pmod(F.xxhash64("id"), F.col("g"))).cast("int")
    same = F.col("c.block").eqNullSafe(F.col("n.block")) & (F.col("c.cell") == F.col("n.cell"))
    both = cells.alias("c").join(n.alias("n"), same).select("c.*", "n.n", "n.g").where("n > 0").withColumn("tile", place)
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("n") + F.col("g")).otherwise(F.col("n")) - 1)))
    pair = [F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")]
    return both.select("block", "cell", *pair, "tile", "id", "x", *(["more"] if "more" in cells.columns else []))


def _bounds_pay(da, db, reach: float) -> bool:
    """Whether distances to pivots rule out most pairs, by some rows of both sides."""
    import numpy as np

    x, y = da[:: 1 + len(da) // 256], db[:: 1 + len(db) // 256]
    close = np.ones((len(x), len(y)), bool)
    for k in range(x.shape[1]):
        close &= np.abs(x[:, k, None] - y[None, :, k]) <= reach
    return bool(close.mean() < 0.1)


def _close_pairs(a, b, points, least: float, reach: float, same: bool):
    """(rows of a, rows of b, cosines, how many products were formed), a few hundred thousand products at a time; same: a is b, each pair once."""
    import numpy as np

    da, db = (np.arccos(np.clip(x @ points.T, -1, 1)) for x in (a, b))
    bounded = len(points) > 1 and _bounds_pay(da, db, reach)
    wide = 4096
    step = max(1, PRODUCTS // max(1, min(wide, len(b))))
    for s in range(0, len(a), step):
        x = a[s : s + step]
        for t in range(s // wide * wide if same else 0, len(b), wide):
            y = b[t : t + wide]
            later = np.arange(s, s + len(x))[:, None] < np.arange(t, t + len(y))[None, :] if same and t < s + len(x) else None
            if bounded:
                close = np.ones((len(x), len(y)), bool) if later is None else later
                for k in range(len(points)):
                    close &= np.abs(da[s : s + step, k, None] - db[None, t : t + wide, k]) <= reach
                rows, cols = np.nonzero(close)
                sims = np.round(np.einsum("ij,ij->i", x[rows], y[cols]), 6)
                good = np.flatnonzero(sims >= least)
                yield s + rows[good], t + cols[good], sims[good], len(rows)
                continue
            products = x @ y.T
            close = products >= least - 1e-6
            if later is not None:
                close &= later
            at = np.flatnonzero(close)
            sims = np.round(products.ravel()[at], 6)
            good = sims >= least
            at, sims = at[good], sims[good]
            yield s + at // len(y), t + at % len(y), sims, int(later.sum()) if later is not None else products.size


def _joined(label, u, v):
    """label (of each node the least known one of its component) after the links u, v."""
    import numpy as np

    while True:
        p, q = label[u], label[v]
        new = p != q
        if not new.any():
            return label
        u, v, p, q = u[new], v[new], p[new], q[new]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def cosine_pairs(rows: DataFrame, least: float, block: Column | str | None = None, vector: str = "embedding", id_col: str = "id", choose: Callable | None = None, extra: str | None = None, pivots: int = PIVOTS, size: int = TILE, with_counts: bool = False, links: bool = False) -> DataFrame:
    """a < b (of one block), sim: pairs with a cosine of ``least`` or more, to six places.

    ``choose`` gets Arrow tables of a, b, sim, of_a, of_b (what ``extra`` is for these) and returns the a, b, sim to keep.
    ``links``: instead a, b that connect what the pairs connect, at most one a row of a tile.  ``with_counts``: instead cell
    and n_tested, the pairs whose product was formed.  Null vectors have no partners; vectors of one length are expected; a
    null block is a block.
    """
    import numpy as np

    block = F.lit("all") if block is None else F.col(block) if isinstance(block, str) else block
    own = rows.select(block.alias("block"), F.col(id_col).alias("id"), F.col(vector).alias("x"), *([F.col(extra).alias("more")] if extra else [])).where("x IS NOT NULL AND id IS NOT NULL")
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    found = pivots_of(own, reach, pivots)
    kind = own.schema["id"].dataType.simpleString()
    schema = "cell int, n_tested long" if with_counts else f"a {kind}, b {kind}" if links else f"a {kind}, b {kind}, sim double"
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    cells, points = _dealt(placed(own, reach, found), size), np.array(found)

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[2].as_py(), key[3].as_py()
        table = pa.Table.from_batches(list(batches))
        tile = table.column("tile").to_numpy()
        order = np.argsort(tile, kind="stable")
        n = int((tile == i).sum())
        ids = table.column("id").combine_chunks().take(pa.array(order))
        more = table.column("more").combine_chunks().take(pa.array(order)) if extra else None
        v = _unit_rows(_matrix(table.column("x")))[order]
        del table
        a, b, first = v[:n], v if i == j else v[n:], 0 if i == j else n
        tested, label, kept, held = 0, np.arange(len(v)), [], 0

        def pairs(found):
            p, q, sims = (np.concatenate(x) for x in zip(*found, strict=True))
            at = [pa.array(p), pa.array(q)]
            swap = pc.less(ids.take(at[1]), ids.take(at[0])).to_numpy(zero_copy_only=False)
            at = [pa.array(np.where(swap, q, p)), pa.array(np.where(swap, p, q))]
            cells = {"a": ids.take(at[0]), "b": ids.take(at[1]), "sim": pa.array(sims)}
            if extra:
                cells |= {"of_a": more.take(at[0]), "of_b": more.take(at[1])}
            out = pa.table(cells)
            return (choose(out) if choose else out).select(["a", "b", "sim"]).to_batches(max_chunksize=100_000)

        for p, q, sims, formed in _close_pairs(a, b, points, least, reach, i == j) if len(a) and len(b) else ():
            tested += formed
            if with_counts:
                continue
            if links:
                label = _joined(label, p, first + q)
                if not label.any():
                    break
            elif len(p):
                kept.append((p, first + q, sims))
                held += len(p)
                if held >= HELD:
                    yield from pairs(kept)
                    kept, held = [], 0
        if with_counts:
            yield pa.RecordBatch.from_pydict({"cell": pa.array([key[1].as_py()], pa.int32()), "n_tested": pa.array([tested], pa.int64())})
        elif links:
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[at])), ids.take(pa.array(at))], names=["a", "b"])
        elif kept:
            yield from pairs(kept)

    return cells.groupBy("block", "cell", "i", "j").applyInArrow(compare, schema)


def cosine_links(rows: DataFrame, least: float, block: Column | str | None = None, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """a, b: links with the components of ``cosine_pairs``, without its pairs."""
    return cosine_pairs(rows, least, block, vector, id_col, links=True)


# edit ratios


def grams(name: Column, q: int) -> Column:
    """(gram, which occurrence of it, place) of a name; a gram that comes again is another token."""
    n = F.length(name) - q + 1
    places = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substring(name, i, q).alias("g"), i.cast("int").alias("at")))).otherwise(F.array().cast("array<struct<g:string,at:int>>"))
    ordered = F.array_sort(places)
    return F.transform(ordered, lambda x, i: F.struct(x["g"].alias("g"), (i + 1 - F.array_position(F.transform(ordered, lambda y: y["g"]), x["g"])).cast("int").alias("nth"), x["at"].alias("at")))


def needed(both: Column, least: float, q: int) -> Column:
    """How many q-grams two names of so many characters together share at least, if their ratio is ``least``.

    With e unmatched characters there are (both - e) / 2 matched ones in e + 1 stretches at most, each of which lacks q - 1 grams.
    """
    e = both * (1 - least) + 1e-9
    return F.ceil((both - e) / 2 - (q - 1) * (F.floor(e) + 1) - 1e-6)


def gram_size(least: float) -> int:
    """The largest q by which a share of the grams must be common."""
    return max([1, *(q for q in (2, 3) if least / 2 - (q - 1) * (1 - least) >= 0.2)])


def _prefixes(names: DataFrame, rarity: DataFrame, least: float, q: int) -> DataFrame:
    """name, n (its length), g, nth, at: so many of its rarest grams that a partner must have one of them among its own."""
    shortest = F.ceil(F.col("n") * least / (2 - least) - 1e-9)
    common = F.greatest(needed(F.col("n") + shortest, least, q), F.lit(1))
    tokens = names.select("name", F.length("name").alias("n"), F.explode(grams(F.col("name"), q)).alias("t")).select("name", "n", "t.*")
    ranked = tokens.join(rarity, ["g", "nth"]).groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g", "nth", "at"))).alias("ts"))
    some = F.slice("ts", F.lit(1), F.greatest(F.lit(1), F.size("ts") - common + 1).cast("int"))
    return ranked.select("name", "n", F.explode(some).alias("t")).select("name", "n", "t.g", "t.nth", "t.at")


def ratio_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) of names (column ``name``, each once) among which are all pairs with a ratio of ``least`` or more.

    Names too short for the larger grams are looked up by letters, with the names that are not too long for them.
    """
    q = gram_size(least)
    at_least = lambda d, k: needed(F.length("name") + F.ceil(F.length("name") * least / (2 - least) - 1e-9), least, k) >= 1  # noqa: E731, ARG005

    def by(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
        every = x.select("name").unionByName(y.select("name")).select(F.explode(grams(F.col("name"), k)).alias("t")).select("t.g", "t.nth")
        rarity = cut(every.groupBy("g", "nth").agg(F.count("*").alias("df")))
        p, o = (_prefixes(d, rarity, least, k) for d in (x, y))
        both = p.toDF("a", "n", "g", "nth", "at").join(o.toDF("b", "m", "g", "nth", "to"), ["g", "nth"])
        total = F.col("n") + F.col("m")
        fits = (2 * F.least("n", "m") >= least * total - 1e-9) & (F.abs(F.col("at") - F.col("to")) <= total * (1 - least) + 1e-9 if k > 1 else F.lit(True))
        return both.where(fits).select("a", "b").distinct()

    if q == 1:
        return by(left, right, 1)
    long = [d.where(at_least(d, q)) for d in (left, right)]
    limit = F.length("name") * least / (2 - least)
    brief = [d.where(~at_least(d, q)) for d in (left, right)]
    most = brief[0].unionByName(brief[1]).agg(F.max(F.length("name"))).first()[0]
    if most is None:
        return by(*long, q)
    near = [d.where(limit <= most) for d in (left, right)]
    return by(*long, q).unionByName(by(brief[0], near[1], 1)).unionByName(by(near[0], brief[1], 1)).distinct()


def letters_in_common(a: Column, b: Column) -> Column:
    """How many letters of a are also in b, each as often as both have it."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def scored(pairs: DataFrame, least: float, score: Callable[[str, str], float] = ratio_of) -> DataFrame:
    """(a, b, score) of candidates with a ratio of ``least`` or more; only those with letters enough in common are scored."""
    possible = pairs.where(2 * letters_in_common(F.col("a"), F.col("b")) >= least * (F.length("a") + F.length("b")) - 1e-9)

    def run(batches):
        for pdf in batches:
            pdf["score"] = [score(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[pdf["score"] >= least]

    return possible.mapInPandas(run, "a string, b string, score double")


def ratio_pairs(names: DataFrame, least: float = 0.6) -> DataFrame:
    """a < b, score: the different names (column ``name``) with an edit ratio of ``least`` or more.  Empty and null names have no partners."""
    x = names.select("name").where("name <> ''").distinct()
    return scored(ratio_candidates(x, x, least).where("a < b"), least)


def ratio_matches(left: DataFrame, right: DataFrame, least: float, score: Callable[[str, str], float] = ratio_of) -> DataFrame:
    """a of left, b of right, score: names with a ratio of ``least`` or more, equal ones too."""
    x, y = (d.select("name").where("name <> ''").distinct() for d in (left, right))
    return scored(ratio_candidates(x, y, least), least, score)


def _sorted_names(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``key``: the words of the name in lower case, sorted, as the token-sort score reads it."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            keys = [" ".join(sorted((x or "").lower().split())) for x in batch.column(at).to_pylist()]
            yield batch.append_column("key", pa.array(keys, pa.string()))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", key string")


def hybrid_pairs(rows: DataFrame, sure: float = 0.92, likely: float = 0.70, tokens: float = 88) -> DataFrame:
    """a < b of (id, name, vector) with a cosine of ``sure``, or of ``likely`` and a token-sort score (a's name first) of ``tokens``; sim: the cosine.

    Names are scored once for each two that can have that score, and only rows with such names are compared for ``likely``:
    a name alike is a block of its own, of the rows of both names.
    """
    from ..functions.similarity import token_sort_of

    rows = rows.select("id", "name", "vector").where("vector IS NOT NULL AND id IS NOT NULL")
    certain = cosine_pairs(rows, sure, None, "vector", "id")
    if tokens <= 0:
        return cosine_pairs(rows, min(sure, likely), None, "vector", "id")
    keyed = cut(_sorted_names(rows, "name"))
    names = cut(keyed.select(F.col("key").alias("name")).distinct())
    close = ratio_matches(names, names, tokens / 100 - 1e-6, lambda a, b: token_sort_of(a, b) / 100).where(F.col("score") * 100 >= tokens - 1e-9).where("a <> b").select("a", "b")
    equal = names.select(F.col("name").alias("a"), F.col("name").alias("b")) if tokens <= 100 else close.limit(0)
    # l <= r of two names, and the ways round in which they are alike
    alike = close.unionByName(equal).groupBy(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r")).agg(F.max(F.col("a") <= F.col("b")).alias("lr"), F.max(F.col("a") >= F.col("b")).alias("rl"))
    alike = cut(alike.withColumn("pair", F.concat(F.length("l").cast("string"), F.lit(":"), "l", "r")))
    sides = alike.select("pair", F.col("l").alias("key"), F.when(F.col("l") == F.col("r"), 0).when(F.col("lr") & F.col("rl"), 1).when(F.col("lr"), 3).otherwise(5).alias("side"))
    sides = sides.unionByName(alike.where("l <> r").select("pair", F.col("r").alias("key"), F.when(F.col("lr") & F.col("rl"), 2).when(F.col("lr"), 4).otherwise(6).alias("side")))
    blocks = keyed.join(sides, "key").select("pair", "id", "vector", "side")

    def choose(found):
        a, b, sim = found.column("of_a").to_numpy(), found.column("of_b").to_numpy(), found.column("sim").to_numpy()
        # side 0: one name; 1 and 2: the two names of a pair alike both ways; 3 before 4, and 6 before 5, alike only if that name is a's
        two = ((a == 0) & (b == 0)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)) | ((a == 3) & (b == 4)) | ((a == 6) & (b == 5))
        return found.filter(pa.array(two & (sim < sure)))

    return certain.unionByName(cosine_pairs(blocks, likely, "pair", "vector", "id", choose, "side"))
