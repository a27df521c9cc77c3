"""Methods that write to the store, and the clock of their events."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.api import Compiler, Profile
from lodestone.functions.terms import iso
from lodestone.operators import consolidate
from lodestone.operators.review import parsed
from lodestone.schema import QUADS

ROWS = [
    ("trusted", "a", "p", "x", "literal", 0.9), ("trusted", "a", "p", "y", "literal", 1.1), ("tentative", "a", "p", "x", "literal", 0.7),
    ("trusted", "b", "p", "x", "literal", 0.9), ("trusted", "c", "q", "x", "literal", 0.9), ("trusted", "c", "q", "y", "literal", 0.9), ("other", "a", "p", "z", "literal", 0.9),
]


@pytest.fixture
def compiler(spark, tmp_path):
    c = Compiler(spark, str(tmp_path / "q"))
    c.store.load(spark.createDataFrame(ROWS, QUADS))
    return c


def held(c):
    return {(r.graph, r.s, r.p, r.o, round(r.confidence, 6)) for r in c.store.read().collect()}


def test_contradictions_are_settled(spark, compiler):
    events = compiler.settle_contradictions(["p"], at=F.lit("2024-03-01 10:00:00").cast("timestamp")).orderBy("o").collect()
    assert [(r.s, r.o, r.before, r.after, r.demoted, r.detected_at) for r in events] == [("a", "x", 0.9, 0.63, True, "2024-03-01T10:00:00+00:00"), ("a", "y", 1.1, 0.77, False, "2024-03-01T10:00:00+00:00")]
    assert held(compiler) == {("tentative", "a", "p", "x", 0.7), ("trusted", "a", "p", "y", 0.77)} | {(*r[:4], r[5]) for r in ROWS[3:]}
    quads = compiler.store.read()
    same, none = consolidate.settle_contradictions(quads, [])
    assert none.count() == 0 and same.exceptAll(quads).count() == quads.exceptAll(same).count() == 0


def test_iso(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 600),), (None,)], "at timestamp")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert spark.sql("select timestamp'2024-01-02 12:04:05' at").select(iso("at")).first()[0] == "2024-01-02T03:04:05+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert df.select(iso("at")).collect()[1][0] is None and df.select(iso("at")).first()[0].endswith(".000600+00:00")
    now = df.select(iso().alias("x")).distinct().collect()
    assert len(now) == 1 and datetime.datetime.fromisoformat(now[0].x).tzinfo


def test_garbage_links_and_reviews(spark, compiler):
    seen = spark.createDataFrame([("a", "p", "x", "2024-01-01 00:00:00"), ("n", "p", "x", "2024-02-01 00:00:00")], "s string, p string, o string, first_seen string").withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    kept, gone = compiler.gc_tentative(seen, "2024-01-15")
    assert [r.s for r in kept.collect()] == ["n"] and [r.s for r in gone.collect()] == ["a"]
    assert ("tentative", "a", "p", "x", 0.7) not in held(compiler) and ("trusted", "a", "p", "x", 0.9) in held(compiler)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "iri string, v array<double>")
    links = compiler.deduplicate_entities(v).collect()
    assert [(r.s, r.p, r.o) for r in links] == [("b", "owl:sameAs", "a")] and any(x[:4] == ("trusted", "b", "owl:sameAs", "a") for x in held(compiler))
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.01])], "iri string, v array<double>")
    assert [(r.s, r.p, r.o) for r in compiler.normalize_predicates(v).collect()] == [("q", "owl:equivalentProperty", "p")]
    task = '{"id": 1, "data": {"subject": "s", "predicate": "p", "object_value": "new"}, "annotations": [{"result": []}]}'
    decided = compiler.review(parsed(spark.createDataFrame([(task,)], "value string"))).collect()
    assert [r.accepted for r in decided] == [True] and ("human-review", "s", "p", "new", 1.0) in held(compiler)


def test_texts_are_resolved_before_fragments(spark, tmp_path):
    text = "Then Ada Byron came. She is a poet. " + "nothing else happens in this long sentence. " * 2
    docs = spark.createDataFrame([("d", text)], "source_iri string, text string")
    found = {mode: {(r.s, r.o) for r in Compiler(spark, str(tmp_path / mode), Profile(coreference=mode)).triples(docs).collect()} for mode in ("disabled", "rules")}
    assert found == {"disabled": {("ex:She", "poet")}, "rules": {("ex:Byron", "poet")}}
