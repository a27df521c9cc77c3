"""Passes over a graph that find equivalent names and write what they found: duplicates, predicates, links to a registry.

Each pass returns (quads, links): the graph with the triples that it writes, and these triples
alone.  ``links`` is empty where nothing is alike.  Vectors come with the names
(``iri``, ``v``); ``encoded`` gives hashed trigrams of their labels where no model is at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.terms import local_name, namespace
from ..plans.lineage import cut
from . import corpus, greedy
from .graph import components, intra_similarity
from .similar import cosine_links, cosine_pairs
from .vocab import canonical_by_frequency, canonical_shortest, rewrite

#: Predicates of these namespaces are never renamed.
PROTECTED = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#",
    "rdf:", "rdfs:", "owl:", "skos:",
)


def encoded(names: DataFrame, label: str = "label", dims: int = 64) -> DataFrame:
    """iri, v: hashed trigrams of the label, worked out once for each label; labels of fewer than three characters have no vector."""
    known = names.select(F.col(label).alias("label")).where(F.length("label") >= 3).distinct()
    known = cut(known.select("label", corpus.embedding(F.col("label"), dims).alias("v")))
    return names.select("iri", F.col(label).alias("label")).join(known, "label").select("iri", "v")


def labels_of(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """iri, label: each subject with its least label, or its local name."""
    own = quads if graph is None else quads.where(F.col("graph") == graph)
    named = F.min(F.when(F.col("p") == "rdfs:label", F.col("o")))
    return own.groupBy(F.col("s").alias("iri")).agg(F.coalesce(named, local_name(F.first("s"))).alias("label"))


def _links(mapping: DataFrame, similarity: DataFrame, predicate: str, graph: str) -> DataFrame:
    """A quad from each name to its cluster's canonical one, with the cluster's mean similarity as confidence."""
    both = mapping.where("iri <> canonical").join(similarity, "cluster")
    return both.select(F.lit(graph).alias("graph"), F.col("iri").alias("s"), F.lit(predicate).alias("p"), F.col("canonical").alias("o"), F.lit("iri").alias("o_kind"), F.col("similarity").alias("confidence"))


def _written(quads: DataFrame, links: DataFrame) -> DataFrame:
    """The quads and the links that they do not have yet."""
    key = ["graph", "s", "p", "o"]
    return quads.unionByName(links.join(quads.select(*key), key, "left_anti").select(*quads.columns))


def _clusters(rows: DataFrame, least: float, order: tuple[str, ...], centroid: bool) -> DataFrame:
    """iri, cluster of the clusters of two names or more."""
    found = greedy.leaders(rows.select(F.col("iri").alias("id"), "v", *[c for c in order if c != "id"], F.lit(0).alias("block")), least, "v", order, "block", centroid)
    sized = found.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
    return cut(found.join(sized, "leader").select(F.col("id").alias("iri"), F.col("leader").alias("cluster")))


def deduplicate_entities(quads: DataFrame, vectors: DataFrame, least: float = 0.92, graph: str = "trusted") -> tuple[DataFrame, DataFrame]:
    """Entities whose labels are alike: greedy centroid clusters by iri; each alias gets owl:sameAs to the shortest name."""
    names = quads.where(F.col("graph") == graph).select(F.col("s").alias("iri")).distinct()
    v = vectors.select("iri", "v")
    groups = _clusters(names.join(v, "iri"), least, ("id",), centroid=True)
    alike = intra_similarity(groups.withColumnRenamed("iri", "id"), v.withColumnRenamed("iri", "id"))
    mapping = canonical_shortest(groups).join(groups, "iri")
    links = _links(mapping, alike, "owl:sameAs", graph)
    return _written(quads, links), links


def _predicates(quads: DataFrame, graph: str) -> DataFrame:
    free = ~F.greatest(*[F.col("p").startswith(x) for x in PROTECTED])
    return quads.where((F.col("graph") == graph) & free).groupBy(F.col("p").alias("iri")).agg(F.count("*").alias("n"))


def normalise_predicates(quads: DataFrame, vectors: DataFrame, least: float = 0.88, graph: str = "trusted", rewriting: bool = False) -> tuple[DataFrame, DataFrame]:
    """Predicates whose labels are alike: greedy leaders by frequency; owl:equivalentProperty to the most frequent (then shortest) one.

    ``rewriting``: the graph's triples take the canonical predicate as well.
    """
    counts = cut(_predicates(quads, graph))
    groups = _clusters(counts.select("iri", (-F.col("n")).alias("less")).join(vectors.select("iri", "v"), "iri"), least, ("less", "id"), centroid=False)
    alike = intra_similarity(groups.withColumnRenamed("iri", "id"), vectors.select(F.col("iri").alias("id"), "v"))
    mapping = cut(canonical_by_frequency(groups, counts).join(groups, "iri"))
    links = _links(mapping, alike, "owl:equivalentProperty", graph)
    out = quads
    if rewriting:
        out = quads.where(F.col("graph") != graph).unionByName(rewrite(quads.where(F.col("graph") == graph), mapping.select("iri", "canonical"), ("p",)))
    return _written(out, links), links


def canonicalise_predicates(quads: DataFrame, vectors: DataFrame, least: float = 0.88, graph: str = "trusted") -> tuple[DataFrame, DataFrame]:
    """Predicates connected by similar labels become one: (quads rewritten, mapping iri, canonical).

    A chain of similar pairs is one cluster.  The most frequent predicate (then the shortest) gives the name; one without
    a namespace takes that of the predicate it replaces.
    """
    counts = cut(_predicates(quads, graph))
    rows = counts.join(vectors.select("iri", "v"), "iri")
    groups = components(cosine_links(rows, least, None, "v", "iri")).toDF("iri", "cluster")
    best = canonical_by_frequency(groups, counts).where("iri <> canonical")
    kept = F.when(namespace("canonical") == "", F.concat(namespace("iri"), F.col("canonical"))).otherwise(F.col("canonical"))
    mapping = cut(best.select("iri", kept.alias("canonical")).where("iri <> canonical"))
    own = quads.where(F.col("graph") == graph)
    return quads.where(F.col("graph") != graph).unionByName(rewrite(own, mapping, ("p",))), mapping


def _best_registered(found):
    """Of the pairs that a task holds, for each name of side 1 the best one with a name of side 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    found = found.filter(pc.not_equal(found.column("of_a"), found.column("of_b")))
    new = pc.equal(found.column("of_a"), 1)
    turned = pa.table({"a": pc.if_else(new, found.column("a"), found.column("b")), "b": pc.if_else(new, found.column("b"), found.column("a")), "sim": found.column("sim")})
    turned = turned.sort_by([("a", "ascending"), ("sim", "descending"), ("b", "ascending")]).combine_chunks()
    if not turned.num_rows:
        return turned
    a = turned.column("a")
    other = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy()
    return turned.filter(pa.array(np.concatenate([[True], other])))


def link_entities(quads: DataFrame, registry: DataFrame, new: DataFrame, least: float = 0.90, graph: str = "trusted") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities against a registry: (quads with altLabels, links, entities to register).

    registry, new: iri, label, v.  A new name joins the synonym ring of the most similar registered one (then the least iri), if that is
    similar enough; its label becomes skos:altLabel there, unless that one has it already.  The others are to be registered.
    """
    unknown = cut(new.join(registry.select("iri"), "iri", "left_anti"))
    both = registry.select("iri", "v", F.lit(0).alias("side")).unionByName(unknown.select("iri", "v", F.lit(1).alias("side")))
    pairs = cosine_pairs(both, least, None, "v", "iri", _best_registered, "side")  # a: unknown, b: registered
    top = Window.partitionBy("iri").orderBy(F.desc("sim"), "registered")
    best = pairs.toDF("iri", "registered", "sim").join(unknown.select("iri", "label"), "iri").withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")
    best = cut(best)
    ring = registry.select(F.col("iri").alias("registered"), "label").unionByName(quads.where("p = 'skos:altLabel'").select(F.col("s").alias("registered"), F.col("o").alias("label")))
    fresh = best.join(ring.distinct(), ["registered", "label"], "left_anti")
    links = fresh.groupBy("registered", "label").agg(F.max("sim").alias("sim"))
    links = links.select(F.lit(graph).alias("graph"), F.col("registered").alias("s"), F.lit("skos:altLabel").alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind"), F.col("sim").alias("confidence"))
    return _written(quads, links), links, unknown.join(best.select("iri"), "iri", "left_anti")
