"""Each SQL function on a table worked out by hand."""

import json

import pytest

from lodestone.plans import registry

QUADS = [
    ("t", "kc:a", "rdf:type", "C", "iri", 0.9), ("t", "kc:a", "rdfs:label", "Acme Corp", "literal", 0.9), ("t", "kc:a", "kc:makes", "Anvils", "literal", 0.8), ("t", "kc:a", "kc:size", "9", "literal", 0.8),
    ("t", "kc:b", "rdf:type", "C", "iri", 0.9), ("t", "kc:b", "rdfs:label", "Acme Corps", "literal", 0.5), ("t", "kc:b", "kc:size", "x", "literal", 0.5), ("t", "kc:a", "kc:near", "kc:c", "iri", 0.9), ("t", "kc:b", "kc:near", "kc:c", "iri", 0.9),
    ("u", "kc:d", "rdfs:label", "ACME corp", "literal", 0.5), ("u", "kc:d", "kc:near", "kc:c", "iri", 0.5),
]
CLAIMS = [("kc:a", "kc:size", "9", "d1"), ("kc:a", "kc:size", "9", "d2"), ("kc:a", "kc:size", "8", "d2"), ("kc:a", "kc:size", "7", "d3"), ("kc:a", "kc:makes", "Anvils", "d1"), ("kc:b", "kc:size", "1", None), ("kc:b", "kc:size", "2", "d1")]


@pytest.fixture(scope="module")
def quads(spark):
    d = spark.createDataFrame(QUADS, "graph string, s string, p string, o string, o_kind string, confidence double")
    claims = spark.createDataFrame(CLAIMS, "s string, p string, o string, source_iri string")
    registry.register_sql(d, claims, {"sizes": [("number", "C", "kc:size", "datatype", "xsd:integer")], "none": [("made", "C", "kc:makes", "minCount", "0")]}, ranks=True)
    return d


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def test_explain_contradiction(spark, quads):
    assert rows(spark.sql("SELECT * FROM kc_explain_contradiction('kc:a')")) == [("kc:size", ["7", "8", "9"], ["d2", "d3"])]
    assert rows(spark.sql("SELECT * FROM kc_explain_contradiction('kc:b')")) == []


def test_scores_and_bundles(spark, quads):
    assert rows(spark.sql("SELECT * FROM kc_load_shape_bundle('sizes')")) == [("t", "kc:b", "number")] and rows(spark.sql("SELECT * FROM kc_load_shape_bundle('none')")) == []
    assert spark.sql("SELECT kc_shacl_score('t') AS x, kc_shacl_score('u') AS y").first() == (0.5, 1.0)


def test_load_triples(spark, quads):
    text = json.dumps([{"s": "a", "p": "b", "o": "it's", "confidence": 0.5}, {"s": "a", "p": "b"}, {"s": "a", "p": "c", "o": "d", "o_kind": "iri"}]).replace("'", "\\'")
    assert rows(spark.sql(f"SELECT * FROM kc_load_triples('{text}', 'new')")) == [("new", "a", "b", "it's", "literal", 0.5), ("new", "a", "c", "d", "iri", 1.0)]
    assert rows(spark.sql("SELECT * FROM kc_load_triples('no json', 'new')")) == []


def test_retrieve(spark, quads):
    got = spark.sql("SELECT * FROM kc_rag_retrieve('a makes Anvils', 't', 2)").collect()
    assert (got[0].s, got[0].p, got[0].o, got[0].score) == ("kc:a", "kc:makes", "Anvils", 1.0) and len(got) == 2


def test_duplicates(spark, quads):
    got = rows(spark.sql("SELECT a, b, label, similarity FROM kc_pagerank_find_duplicates(0.4)"))
    assert [(set(r[:2]), r[2]) for r in got] == [({"kc:a", "kc:d"}, "acme corp")]


def test_sparql_in_sql(spark, quads):
    text = "SELECT x.s, q.o FROM kc_sparql('SELECT ?s WHERE { ?s kc:size ?n FILTER(?n > 5) }') x JOIN kc_quads q ON q.s = x.s AND q.p = 'rdfs:label'"
    assert rows(registry.sql(quads, text)) == [("kc:a", "Acme Corp")]
    assert registry.sql(quads, "SELECT count(*) n FROM KC_SPARQL ('SELECT ?s WHERE { ?s ?p \"it''s\" }')".replace("KC_SPARQL (", "KC_SPARQL(")).first().n == 0
