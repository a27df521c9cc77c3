import pytest
from pyspark.sql import functions as F

from lodestone.api import Compiler, Profile
from lodestone.operators import corpus
from lodestone.plans import registry

TEXT = "Ada is a poet. Bob has money. " + "Nothing else happens in this long sentence. " * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d1", TEXT), ("d2", TEXT), ("d3", "short")], "source_iri string, text string")


def test_compile_query_update(spark, tmp_path, docs):
    c = Compiler(spark, str(tmp_path / "q"), Profile(competency_questions=[{"id": "q", "sparql": "ASK { ex:Ada kc:isA ?x }"}]))
    c.ingest(docs)
    c.ingest(docs)
    assert c.store.count() == 2
    assert [tuple(r) for r in c.query("SELECT ?o WHERE { ex:Ada kc:isA ?o }").collect()] == [("poet",)]
    assert c.competency().first().passed
    assert {r.status for r in c.recompile(docs).collect()} == {"unchanged"}
    c.update('DELETE DATA { GRAPH <trusted> { ex:Ada kc:isA "poet" } }')
    assert c.store.count() == 1
    assert c.render().count() == 1 and c.context().count() == 1
    c.clear_graph("trusted")
    assert c.store.count() == 0


def test_profile_drops_unknown_keys(tmp_path):
    (tmp_path / "p.yaml").write_text("name: x\nnot_a_key: 1\ntrusted: 0.9\n")
    assert Profile.load(str(tmp_path / "p.yaml")).trusted == 0.9


def test_registry():
    assert set(registry.names("fragmenters")) >= {"heading", "direct", "statement", "semantic"}
    registry.register("extractors", "own", lambda x: x)
    assert registry.get("extractors", "own")(1) == 1
    with pytest.raises(KeyError):
        registry.get("parsers", "missing")


def test_corpus_views(spark, docs):
    d = spark.createDataFrame([("d1", "Ada Lovelace met Charles Babbage. Ada Lovelace wrote."), ("d2", "Lovelace Ada and Ada Lovelace spoke.")], "source_iri string, text string")
    m = corpus.mentions(d)
    assert {(r.source_iri, r.mention) for r in m.collect()} == {("d1", "Ada Lovelace"), ("d1", "Charles Babbage"), ("d2", "Lovelace Ada"), ("d2", "Ada Lovelace")}
    assert {r.canonical: r.aliases for r in corpus.catalog(m).collect()} == {"Ada Lovelace": ["Lovelace Ada"], "Charles Babbage": []}
    v = docs.select("source_iri", corpus.embedding(F.col("text")).alias("v"))
    one, two = (r.v for r in v.orderBy("source_iri").limit(2).collect())
    assert one == two and sum(x * x for x in one) == pytest.approx(1)
    assert {r.cluster for r in corpus.clusters(docs, 3).collect()} == {0}
    many = spark.range(40).select(F.concat(F.lit("d"), "id").alias("source_iri"), F.when(F.col("id") % 2 == 0, "cats and dogs").otherwise("stocks or bonds").alias("text"))
    got = {(r.text, r.cluster) for r in corpus.clusters(many, 40).join(many, "source_iri").collect()}
    assert len(got) == 2
    n = v.select("source_iri", F.col("source_iri").alias("iri"), "v", F.lit(0).alias("block"))
    assert {(r.iri, r.registered) for r in corpus.linked(n.where("iri = 'd2'"), n.where("iri = 'd1'")).collect()} == {("d2", "d1")}
    same = spark.createDataFrame([("s", "Ada Lovelace", [1.0, 0.0]), ("s", "Lovelace Ada", [0.8, 0.6]), ("s", "Bob", [0.0, 1.0])], "source_iri string, name string, v array<double>")
    assert [(r.a, r.b, r.confidence) for r in corpus.resolved(same).collect()] == [("Ada Lovelace", "Lovelace Ada", 0.9)]
