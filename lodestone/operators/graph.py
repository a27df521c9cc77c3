"""Fixpoints on triples: components, closure, rules, rank, close names, duplicates by rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.terms import jaccard, trigrams
from ..plans.lineage import LEAST_HOT, cut, hot_join


def fixpoint(facts: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], most: int = 1000) -> DataFrame:
    """Semi-naive: step(all, new) gives candidates; those not known yet are the next new ones, until there are none."""
    known = cut(facts.select(*key).distinct())
    new = known
    for _ in range(most):
        new = cut(step(known, new).select(*key).distinct().join(known, key, "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    raise RuntimeError(f"no fixpoint in {most} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(iri, component) for the ends of edges (a, b); component is the least name reachable.

    Each round links every node to its least neighbour on both sides (large and small
    stars); only an unchanged set of edges ends the rounds.  The least node of a large
    component has all its members as neighbours: such nodes are joined where their rows are.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("iri"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("iri"), F.col("v").alias("component")))
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        above = F.count(F.when(F.col("v") > F.col("u"), 1)).alias("c")
        least = both.groupBy("u").agg(F.min("v").alias("m"), above).where("c > 0").select("u", F.least("u", "m").alias("m"), "c")
        large = hot_join(both.where("v > u"), least, "u", "c", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, mark[0]) if mark[0] > LEAST_HOT else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = hot_join(large, least, "u", "c", mark[0]).select(F.explode(pairs).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct(), mark[0])


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure of (s, o)."""

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        return new.alias("n").join(edges.select(F.col("s").alias("m"), F.col("o").alias("t")).alias("e"), F.col("n.o") == F.col("e.m")).select("n.s", F.col("e.t").alias("o"))

    return fixpoint(edges, step, ["s", "o"])


def owl_closure(quads: DataFrame) -> DataFrame:
    """s, p, o: the quads and what the rules add: subclasses, their instances, domain, range, inverse and transitive properties."""

    def with_p(d: DataFrame, p: str, *names: str) -> DataFrame:
        return d.where(F.col("p") == p).select(*[F.col(a).alias(b) for a, b in zip(("s", "o"), names, strict=True)])

    schema = quads.where(F.col("p").isin("rdfs:subClassOf", "rdfs:domain", "rdfs:range", "owl:inverseOf") | (F.col("o") == "owl:TransitiveProperty")).select("s", "p", "o")
    schema = cut(schema)
    transitive = schema.where("p = 'rdf:type'").select(F.col("s").alias("tp"))
    inverse = with_p(schema, "owl:inverseOf", "p", "q")
    inverse = inverse.unionByName(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    sub = closure(with_p(schema, "rdfs:subClassOf", "s", "o"))

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        typed = new.where("p = 'rdf:type'").join(sub.select(F.col("s").alias("o"), F.col("o").alias("t")), "o").select("s", "p", F.col("t").alias("o"))
        domain = new.join(with_p(schema, "rdfs:domain", "p", "t"), "p").select("s", F.lit("rdf:type").alias("p"), F.col("t").alias("o"))
        range_ = new.join(with_p(schema, "rdfs:range", "p", "t"), "p").select(F.col("o").alias("s"), F.lit("rdf:type").alias("p"), F.col("t").alias("o"))
        back = new.join(inverse, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
        fresh, all_ = (d.join(transitive, F.col("p") == F.col("tp"), "left_semi") for d in (new, known))
        hop = lambda a, b: a.alias("a").join(b.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.s"))).select("a.s", "a.p", "b.o")
        return typed.unionByName(domain).unionByName(range_).unionByName(back).unionByName(hop(fresh, all_)).unionByName(hop(all_, fresh))

    sub_rows = sub.select("s", F.lit("rdfs:subClassOf").alias("p"), "o")
    return fixpoint(quads.select("s", "p", "o").unionByName(sub_rows), step, ["s", "p", "o"])


def new_facts(closed: DataFrame, quads: DataFrame, most: int | None = None) -> DataFrame:
    """What a closure adds, with ``most`` the first so many by s, p, o."""
    out = closed.join(quads.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return out.orderBy("s", "p", "o").limit(most) if most else out


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(iri, rank) of a directed graph (a, b); the rank of nodes without a way out is lost, as usual for fixed rounds."""
    each = F.count("*").over(Window.partitionBy("a"))
    links = cut(edges.select("a", "b").repartition("a").distinct().withColumn("n", each))
    nodes = cut(links.select(F.col("a").alias("iri")).union(links.select("b")).distinct())
    none, rank = nodes.select("iri", F.lit(0.0).alias("x")), nodes.withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        ranked = links.join(rank.withColumnRenamed("iri", "a"), "a") if i else links.withColumn("rank", F.lit(1.0))
        given = ranked.select(F.col("b").alias("iri"), (F.col("rank") / F.col("n")).alias("x"))
        rank = given.unionByName(none).groupBy("iri").agg(F.sum("x").alias("x")).select("iri", ((1 - damping) + damping * F.col("x")).alias("rank"))
        if i % 3 == 2:
            rank = cut(rank)
    return rank


def close_names(names: DataFrame, most: int = 3) -> DataFrame:
    """a < b, distance, overlap (of their words): names at most so many edits apart.

    Cut evenly into most + 1 pieces, one name has a piece that the other holds unchanged, at
    most ``most`` places off.  So pairs meet by (length, piece, text) and none is lost.
    """
    x = names.select("name", F.length("name").alias("n")).distinct()
    k = most + 1
    begin = lambda n, i: F.floor(n * i / k).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.substring(F.col("name"), begin(F.col("n"), i) + 1, begin(F.col("n"), i + 1) - begin(F.col("n"), i)).alias("text")))
    own = x.select("name", F.col("n").alias("m"), F.explode(pieces).alias("p")).select("name", "m", "p.*")
    probe = x.select(F.col("name").alias("other"), "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n"))).alias("m"))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    at, size = begin(F.col("m"), F.col("i")) + F.col("shift"), begin(F.col("m"), F.col("i") + 1) - begin(F.col("m"), F.col("i"))
    probe = probe.where((at >= 0) & (at + size <= F.col("n"))).select("other", "m", "i", F.substring("other", at + 1, size).alias("text")).distinct()
    pairs = own.join(probe, ["m", "i", "text"]).where("name <> other").select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0").withColumn("overlap", F.round(jaccard(words("a"), words("b")), 6))


def suggestions(names: DataFrame, most: int = 3, k: int = 5) -> DataFrame:
    """For each name its ``k`` closest ones (a, b, distance, overlap): fewest edits, then most words in common."""
    pairs = close_names(names, most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance", "overlap"))
    w = Window.partitionBy("a").orderBy("distance", F.desc("overlap"), "b")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def rank_duplicates(rank: DataFrame, labels: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, label, similarity: nodes of one label whose neighbours overlap (Jaccard); the better ranked one first.

    A label of many nodes is joined on (label, neighbour), so only nodes that share a neighbour meet.  A node takes its number of
    neighbours and its rank along, so that pairs are joined with nothing, and two whose numbers differ too much do not meet.
    """
    neighbours = edges.select(F.col("a").alias("iri"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("iri"), F.col("a").alias("near"))).repartition("iri").distinct()
    own = neighbours.join(labels.select("iri", F.lower("label").alias("label")).distinct(), "iri").withColumn("n", F.count("*").over(Window.partitionBy("iri", "label")))
    own = cut(own.join(rank.select("iri", "rank"), "iri"))
    x, y = (own.select("label", "near", *[F.col(c).alias(f"{name}{c}") for c in ("iri", "n", "rank")]) for name in "xy")
    fits = (F.col("xiri") < F.col("yiri")) & (F.least("xn", "yn") >= (least - 1e-6) * F.greatest("xn", "yn"))
    common = x.join(y, ["label", "near"]).where(fits).groupBy("xiri", "yiri", "label", "xn", "yn", "xrank", "yrank").agg(F.count("*").alias("c"))
    sim = F.round(F.col("c") / (F.col("xn") + F.col("yn") - F.col("c")), 6)
    first = F.col("xrank") >= F.col("yrank")
    return common.select(F.when(first, F.col("xiri")).otherwise(F.col("yiri")).alias("a"), F.when(first, F.col("yiri")).otherwise(F.col("xiri")).alias("b"), "label", sim.alias("similarity")).where(F.col("similarity") >= least)


def trigram_matches(query: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """(q, label, score): labels that share trigrams with a query, through an inverted index."""
    q = query.select("q", trigrams("q").alias("tq"))
    x = labels.select("label", trigrams("label").alias("tl"))
    hits = q.select("q", F.explode("tq").alias("t")).join(x.select("label", F.explode("tl").alias("t")), "t").select("q", "label").distinct()
    return hits.join(q, "q").join(x, "label").select("q", "label", F.round(jaccard("tq", "tl"), 6).alias("score")).where(F.col("score") >= least)


def intra_similarity(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per cluster the mean cosine of its pairs (1 for a single member), from the sum of its unit vectors: no pair is formed."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    x = clusters.select("cluster", "id").join(vectors, "id").select("cluster", "v", norm.alias("norm"))
    parts = x.select("cluster", F.posexplode(F.transform("v", lambda y: y.cast("double") / F.col("norm"))).alias("i", "y")).groupBy("cluster", "i").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    total = parts.groupBy("cluster").agg(F.sum(F.col("y") * F.col("y")).alias("square"), F.max("n").alias("n"))
    mean = (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return total.select("cluster", F.when(F.col("n") > 1, F.round(mean, 6)).otherwise(1.0).alias("similarity"))


def centroids(rows: DataFrame, by: str = "cluster", vector: str = "v") -> DataFrame:
    """Per cluster the mean vector."""
    parts = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(by, F.transform("c", lambda s: s["m"]).alias("centroid"))
