import pytest

from lodestone.plans import rules
from lodestone.plans.sparql import Engine, Parser, SparqlError

QUADS = [
    ("trusted", "a", "rdf:type", "C", "iri"), ("trusted", "a", "label", "Ada", "literal"), ("trusted", "a", "knows", "b", "iri"), ("trusted", "b", "knows", "c", "iri"), ("trusted", "b", "age", "40", "literal"),
    ("trusted", "c", "age", "5", "literal"), ("tentative", "c", "knows", "a", "iri"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(QUADS, "graph string, s string, p string, o string, o_kind string"))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?x ?z WHERE { ?x :knows ?y . ?y :knows ?z }", [("a", "c"), ("b", "a"), ("c", "b")]),
        ("SELECT ?x WHERE { GRAPH <tentative> { ?x :knows ?y } }", [("c",)]),
        ("SELECT ?g WHERE { GRAPH ?g { <c> :knows ?y } }", [("tentative",)]),
        ("SELECT ?x ?l WHERE { ?x :knows ?y OPTIONAL { ?x :label ?l } }", [("a", "Ada"), ("b", None), ("c", None)]),
        ("SELECT ?x WHERE { { ?x :age ?y } UNION { ?x :label ?y } }", [("a",), ("b",), ("c",)]),
        ("SELECT ?x WHERE { ?x :age ?n FILTER(?n > 6) }", [("b",)]),
        ("SELECT ?x ?n WHERE { ?x :age|:label ?n FILTER(?n > 6) }", [("b", "40")]),
        ("SELECT ?x WHERE { ?x :age|:label ?n FILTER(?n < 6 || ?n >= 40) }", [("b",), ("c",)]),
        ("SELECT ?n WHERE { ?x :age|:label ?n FILTER(?n != 5) }", [("40",), ("Ada",)]),
        ("SELECT ?n WHERE { ?x :age|:label ?n FILTER(?n = 5.0) }", [("5",)]),
        ("SELECT ?n WHERE { ?x :age|:label ?n FILTER(!(?n > 6)) }", [("5",)]),
        ("SELECT ?y WHERE { <a> !:knows ?y }", [("Ada",), ("C",)]),
        ("SELECT ?y WHERE { <b> !(:knows|:label) ?y }", [("40",)]),
        ("SELECT ?x ?y WHERE { ?x !(a|:age|:label|^:label) ?y }", [("C", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]),
        ("SELECT (GROUP_CONCAT(?y; SEPARATOR = \", \") AS ?l) WHERE { ?x :age ?y }", [("40, 5",)]),
        ("SELECT ?x (GROUP_CONCAT(DISTINCT ?y) AS ?l) WHERE { ?x :age|:knows|:age ?y } GROUP BY ?x", [("a", "b"), ("b", "40 c"), ("c", "5 a")]),
        ("SELECT ?p (SAMPLE(?y) AS ?l) WHERE { ?x ?p ?y } GROUP BY ?p HAVING(COUNT(?y) > 2)", [("knows", "a")]),
        ("SELECT ?x WHERE { ?x :age ?n } ORDER BY DESC(?n) LIMIT 1", [("b",)]),
        ("SELECT ?x WHERE { ?x :knows ?y FILTER NOT EXISTS { ?x :age ?n } }", [("a",)]),
        ("SELECT ?x WHERE { ?x :knows ?y FILTER EXISTS { ?x :age ?n } }", [("b",), ("c",)]),
        ("SELECT ?x WHERE { VALUES ?x { <a> <b> } ?x :age ?n }", [("b",)]),
        ("SELECT (COUNT(?x) AS ?n) WHERE { ?x :knows ?y }", [(3,)]),
        ("SELECT ?x (COUNT(DISTINCT ?y) AS ?n) WHERE { ?x :knows ?y } GROUP BY ?x", [("a", 1), ("b", 1), ("c", 1)]),
        ("SELECT ?x WHERE { ?x ?p ?o FILTER(isLiteral(?o) && STRSTARTS(STR(?o), \"A\")) }", [("a",)]),
        ("SELECT ?x WHERE { ?x :age ?n FILTER(?n IN (\"5\", \"6\")) }", [("c",)]),
        ("SELECT ?x ?m WHERE { ?x :age ?n BIND(?n * 2 AS ?m) FILTER(?m >= 80) }", [("b", "80.0")]),
        ("SELECT ?z WHERE { <a> :knows / :knows ?z }", [("c",)]),
        ("SELECT DISTINCT ?x WHERE { ?x a <C> ; :label ?l , ?m }", [("a",)]),
        # MINUS without a common variable takes nothing away
        ("SELECT ?x WHERE { ?x :age ?n MINUS { ?a :label ?b } }", [("b",), ("c",)]),
        ("SELECT ?x WHERE { ?x :knows ?y MINUS { ?x :label ?b } }", [("b",), ("c",)]),
        # filters of OPTIONAL and EXISTS see what is around them
        ("SELECT ?x ?w WHERE { ?x :age ?v OPTIONAL { ?y :age ?w FILTER(?w > ?v) } }", [("b", None), ("c", "40")]),
        ("SELECT ?x WHERE { ?x :age ?v FILTER EXISTS { ?y :age ?w FILTER(?w > ?v) } }", [("c",)]),
        ("SELECT ?x WHERE { ?x :age ?v FILTER NOT EXISTS { ?y :age ?w FILTER(?w > ?v) } }", [("b",)]),
        # unbound is compatible with anything, and is filled
        ("SELECT ?x ?l WHERE { ?x :knows ?y OPTIONAL { ?x :label ?l } OPTIONAL { ?x :age ?l } }", [("a", "Ada"), ("b", "40"), ("c", "5")]),
        ("SELECT ?x ?l WHERE { ?x :knows ?y OPTIONAL { ?x :label ?l } ?z :age ?l }", [("b", "40"), ("b", "5"), ("c", "40"), ("c", "5")]),
        ("SELECT ?x ?n WHERE { VALUES (?x ?n) { (<b> UNDEF) (UNDEF \"5\") } ?x :age ?n }", [("b", "40"), ("c", "5")]),
        # paths
        ("SELECT ?z WHERE { <a> :knows+ ?z }", [("a",), ("b",), ("c",)]),
        ("SELECT ?z WHERE { <b> :knows* ?z }", [("a",), ("b",), ("c",)]),
        ("SELECT ?z WHERE { <b> :knows? ?z }", [("b",), ("c",)]),
        ("SELECT ?z WHERE { ?z :knows+ <b> }", [("a",), ("b",), ("c",)]),
        ("SELECT ?z WHERE { <c> ^:knows ?z }", [("b",)]),
        ("SELECT ?z WHERE { <b> :age|:knows ?z }", [("40",), ("c",)]),
        ("SELECT ?x ?n WHERE { ?x :knows/(:knows/:age) ?n }", [("a", "5"), ("c", "40")]),
        ("SELECT ?x ?n WHERE { ?x (:knows|^:knows)/:age ?n }", [("a", "40"), ("a", "5"), ("b", "5"), ("c", "40")]),
        ("SELECT ?x ?y WHERE { ?x :knows+ ?y . ?y :label ?l }", [("a", "a"), ("b", "a"), ("c", "a")]),
        # aggregates
        ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?x ?p ?y } GROUP BY ?p HAVING (COUNT(*) > 2)", [("knows", 3)]),
        ("SELECT (COUNT(?x) * 2 + 1 AS ?n) WHERE { ?x :knows ?y }", [(7.0,)]),
        ("SELECT (MIN(?n) AS ?a) (MAX(?n) AS ?b) WHERE { ?x :age ?n }", [("5", "40")]),
        ("SELECT ?x ?n WHERE { { SELECT (MAX(?a) AS ?n) WHERE { ?y :age ?a } } ?x :age ?n }", [("b", "40")]),
        ("SELECT ?x ?k WHERE { ?x :age ?n { SELECT ?x (COUNT(?y) AS ?k) WHERE { ?x :knows ?y } GROUP BY ?x } }", [("b", "1"), ("c", "1")]),
    ],
)
def test_select(engine, text, want):
    assert got(engine.query("PREFIX : <> " + text)) == want


def test_order_survives_distinct(engine):
    rows = engine.query("PREFIX : <> SELECT DISTINCT ?p WHERE { ?x ?p ?o } ORDER BY DESC(?p) LIMIT 2").collect()
    assert [r[0] for r in rows] == ["rdf:type", "label"]
    assert [r[0] for r in engine.query("PREFIX : <> SELECT DISTINCT ?x WHERE { ?x :age ?n } ORDER BY ?n").collect()] == ["c", "b"]
    assert [r[0] for r in engine.query("PREFIX : <> SELECT ?x WHERE { ?x :knows ?y } GROUP BY ?x ORDER BY DESC(COUNT(?y)) ?x").collect()] == ["a", "b", "c"]


def test_describe(engine):
    assert got(engine.query("PREFIX : <> DESCRIBE <b>").select("s", "p", "o")) == [("a", "knows", "b"), ("b", "age", "40"), ("b", "knows", "c")]
    assert got(engine.query("PREFIX : <> DESCRIBE ?x WHERE { ?x :label ?l }").select("s", "p")) == [("a", "knows"), ("a", "label"), ("a", "rdf:type"), ("c", "knows")]


def test_ask_and_construct(engine, spark):
    assert engine.ask("PREFIX : <> ASK { ?x :age \"5\" }")
    assert not engine.ask("PREFIX : <> ASK { ?x :age \"6\" }")
    q = engine.quads.selectExpr("*", "1.0 as confidence")
    made = rules.construct(q, ["PREFIX : <> CONSTRUCT { ?x :reaches ?y } WHERE { ?x :knows ?y }", "PREFIX : <> CONSTRUCT { ?x :reaches ?z } WHERE { ?x :reaches ?y . ?y :knows ?z }"], rounds=5)
    assert made.count() == 9 and {r.graph for r in made.collect()} == {"inferred"}


def test_updates(engine):
    n = engine.quads.count()
    assert engine.query("PREFIX : <> INSERT DATA { GRAPH <trusted> { <z> :knows <a> } }").count() == n + 1
    assert engine.query("PREFIX : <> INSERT DATA { GRAPH <trusted> { <a> :knows <b> } }").count() == n
    assert engine.query("PREFIX : <> DELETE DATA { GRAPH <trusted> { <a> :knows <b> } }").count() == n - 1
    assert engine.query("PREFIX : <> DELETE WHERE { GRAPH <trusted> { ?x :age ?y } }").count() == n - 2
    moved = engine.query("PREFIX : <> DELETE { GRAPH <trusted> { ?x :age ?y } } INSERT { GRAPH <trusted> { ?x :years ?y } } WHERE { ?x :age ?y }")
    assert moved.where("p = 'years'").count() == 2 and moved.where("p = 'age'").count() == 0


@pytest.mark.parametrize("text", ["SELECT ?x { ?x", "FROB ?x", "SELECT ?x WHERE { ?x ?p ?o FILTER(nope(?x)) }", "SELECT ?x WHERE { ?x ?p }"])
def test_errors_are_raised(engine, text):
    with pytest.raises(SparqlError):
        engine.query(text)


def test_graph_is_a_filter_of_the_scan(engine):
    assert Parser("SELECT * WHERE { GRAPH <g> { ?s ?p ?o } }").query().where.parts[0][0] == "graph"


def test_service_reads_only_the_keys_that_are_known(spark, tmp_path):
    local = spark.createDataFrame([("g", f"c{i}", "in", f"n{i % 3}", "iri") for i in range(9)] + [("g", "c1", "name", "one", "literal")], "graph string, s string, p string, o string, o_kind string")
    far = spark.createDataFrame([("h", f"n{i}", "part", f"r{i % 2}", "iri") for i in range(6)] + [("k", "n0", "part", "other", "iri")], "graph string, s string, p string, o string, o_kind string")
    far.write.parquet(str(tmp_path / "far"))
    engine = Engine(local, services={"http://far/": spark.read.parquet(str(tmp_path / "far"))})
    text = "PREFIX : <> SELECT ?c ?r WHERE { ?c :in ?n SERVICE <http://far/> { GRAPH <h> { ?n :part ?r } } }"
    want = sorted((f"c{i}", f"r{i % 3 % 2}") for i in range(9))
    assert got(engine.query(text)) == want
    assert "In(s, [n0,n1,n2])" in engine.query(text)._jdf.queryExecution().executedPlan().toString()
    few = Engine(local, services=engine.services, most_keys=2)
    assert got(few.query(text)) == want and "In(s" not in few.query(text)._jdf.queryExecution().executedPlan().toString()
    assert len(got(engine.query("PREFIX : <> SELECT ?s ?p ?o WHERE { SERVICE <http://far/> { GRAPH ?g { ?s ?p ?o } } }"))) == 7
    assert got(engine.query("PREFIX : <> SELECT ?c ?n WHERE { ?c :name \"one\" . ?c :in ?x SERVICE <http://far/> { SELECT ?x (COUNT(?r) AS ?n) WHERE { ?x :part ?r } GROUP BY ?x } }")) == [("c1", "1")]
    assert got(engine.query("PREFIX : <> SELECT ?c WHERE { ?c :name ?n SERVICE SILENT <http://gone/> { ?c :x ?y } }")) == [("c1",)]
    with pytest.raises(SparqlError):
        engine.query("PREFIX : <> SELECT ?c WHERE { ?c :name ?n SERVICE <http://gone/> { ?c :x ?y } }")
