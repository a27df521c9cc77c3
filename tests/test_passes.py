"""Passes that write links: hand cases with known vectors, against loops where an order decides."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import passes

from .test_similar import one_by_one

QUADS = "graph string, s string, p string, o string, o_kind string, confidence double"


def quads(spark, *rows):
    return spark.createDataFrame([("trusted", s, p, o, "literal", 0.9) for s, p, o in rows], QUADS)


def turned(*degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


def test_entities(spark):
    r = random.Random(3)
    names = [f"ex:{'x' * r.randint(1, 6)}{i}" for i in range(40)]
    v = np.random.default_rng(3).standard_normal((8, 3))[np.arange(40) % 8] + 0.25 * np.random.default_rng(4).standard_normal((40, 3))
    q = quads(spark, *[(n, "rdfs:label", n) for n in names], ("ex:none", "p", "1"))
    vectors = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v, strict=True)], "iri string, v array<double>")
    out, links = passes.deduplicate_entities(q, vectors, 0.92)
    order = sorted(range(40), key=lambda i: names[i])
    clusters = {}
    for i, head in one_by_one(order, v, 0.92, True).items():
        clusters.setdefault(head, []).append(i)
    want = {}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for members in clusters.values():
        best = min(members, key=lambda i: (len(names[i]), names[i]))
        sims = [unit[i] @ unit[j] for i in members for j in members if i < j]
        want |= {(names[i], names[best]): np.mean(sims) for i in members if i != best}
    got = {(r.s, r.o): r.confidence for r in links.collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    assert out.count() == q.count() + len(want) and {r.p for r in links.collect()} == {"owl:sameAs"}
    again, _ = passes.deduplicate_entities(out, vectors, 0.92)
    assert again.count() == out.count()


def test_predicates(spark):
    q = quads(spark, *[("a", "ex:hasAuthor", str(i)) for i in range(3)], *[("a", "ex:author", str(i)) for i in range(5)], ("a", "ex:writer", "w"), ("a", "rdfs:label", "x"), ("a", "rdfs:label", "y"), ("a", "ex:far", "z"))
    vectors = spark.createDataFrame([(n, x) for n, x in zip(["ex:author", "ex:hasAuthor", "ex:writer", "rdfs:label", "ex:far"], turned(0, 20, 40, 1, 90), strict=True)], "iri string, v array<double>")
    out, links = passes.normalise_predicates(q, vectors, 0.88, rewriting=True)
    assert {(r.s, r.p, r.o) for r in links.collect()} == {("ex:hasAuthor", "owl:equivalentProperty", "ex:author")}  # writer is 40 degrees from author, and label protected
    assert {r.p: r["count"] for r in out.groupBy("p").count().collect()} == {"ex:author": 8, "ex:writer": 1, "ex:far": 1, "rdfs:label": 2, "owl:equivalentProperty": 1}
    plain, _ = passes.normalise_predicates(q, vectors, 0.88)
    assert plain.count() == q.count() + 1 and plain.where("p = 'ex:hasAuthor'").count() == 3
    out, mapping = passes.canonicalise_predicates(q, vectors, 0.88)
    assert {(r.iri, r.canonical) for r in mapping.collect()} == {("ex:hasAuthor", "ex:author"), ("ex:writer", "ex:author")}  # a chain is one cluster
    assert {r.p: r["count"] for r in out.groupBy("p").count().collect()} == {"ex:author": 9, "ex:far": 1, "rdfs:label": 2}
    nothing, links = passes.normalise_predicates(q, vectors.where("iri = 'none'"))
    assert links.count() == 0 and nothing.count() == q.count()


def test_links_to_a_registry(spark):
    kind = "iri string, label string, v array<double>"
    registry = spark.createDataFrame([("r:1", "Ada", turned(0)[0]), ("r:2", "Bob", turned(60)[0]), ("r:3", "Ada", turned(4)[0])], kind)
    new = spark.createDataFrame([("n:1", "Ada L", turned(2)[0]), ("n:2", "Bob", turned(61)[0]), ("n:3", "Cy", turned(120)[0]), ("n:4", "Ada L", turned(1)[0]), ("r:1", "Ada", turned(0)[0])], kind)
    q = quads(spark, ("r:2", "rdfs:label", "Bob"))
    out, links, register = passes.link_entities(q, registry, new)
    assert {(r.s, r.p, r.o) for r in links.collect()} == {("r:1", "skos:altLabel", "Ada L")}  # 2 degrees to both: the least iri; Bob is known there
    assert {r.iri for r in register.collect()} == {"n:3"} and out.count() == 2
    _, links, _ = passes.link_entities(out, registry, new)
    assert links.count() == 0


def test_names_from_labels(spark):
    q = quads(spark, ("ex:one_name", "p", "1"), ("ex:b", "rdfs:label", "z"), ("ex:b", "rdfs:label", "a"))
    names = passes.labels_of(q)
    assert {(r.iri, r.label) for r in names.collect()} == {("ex:one_name", "one_name"), ("ex:b", "a")}
    assert passes.encoded(names.withColumn("label", F.lit("abc"))).count() == 2 and passes.encoded(names.withColumn("label", F.lit(""))).count() == 0


def test_of_a_tasks_pairs_only_the_best_of_each_name_go_on():
    import pyarrow as pa

    found = pa.table({"a": ["n1", "n1", "r1", "n1", "n2"], "b": ["r2", "r3", "n2", "n2", "r9"], "sim": [0.9, 0.9, 0.8, 1.0, 0.7], "of_a": [1, 1, 0, 1, 1], "of_b": [0, 0, 1, 1, 0]})
    assert passes._best_registered(found).to_pylist() == [{"a": "n1", "b": "r2", "sim": 0.9}, {"a": "n2", "b": "r1", "sim": 0.8}]
    assert passes._best_registered(found.slice(3, 1)).num_rows == 0
