"""Operators on small inputs with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity, terms as t
from lodestone.operators import consolidate as co, evaluate as ev, gate, graph as gr, greedy, knowledge as kn, text as tx, vocab as vo


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


CLAIMS = "s string, p string, o string, source_iri string, confidence double"


@pytest.mark.parametrize(
    ("claims", "final", "n"),
    [
        ([("a", "p", "x", "d1", 0.8), ("a", "p", "x", "d2", 0.8)], 0.96, 2),
        ([("a", "p", "x", "d1", 0.8), ("A ", "p", "X", "d1", 0.7)], 0.8, 1),
        ([("a", "p", "x", "d1", 0.5), ("a", "p", "x", "d2", 0.6), ("a", "p", "x", "d3", 0.7)], 0.94, 3),
        ([("a", "p", "x", "d1", 1.0), ("a", "p", "x", "d2", 0.1)], 1.0, 2),
    ],
)
def test_noisy_or(spark, claims, final, n):
    assert rows(co.noisy_or(spark.createDataFrame(claims, CLAIMS)), "final_confidence", "n_sources") == [(final, n)]


def test_noisy_or_does_not_depend_on_order_or_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 7).alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.concat(F.lit("d"), F.col("id") % 11).alias("source_iri"), ((F.col("id") % 13) / 26).alias("confidence"))
    want = rows(co.noisy_or(df), "s", "final_confidence", "n_sources")
    assert rows(co.noisy_or(df.repartition(9).orderBy(F.rand(3))), "s", "final_confidence", "n_sources") == want


def test_promotion_threshold_is_inclusive_and_repeatable(spark):
    c = spark.createDataFrame([("a", "p", "x", "d1", 0.5), ("a", "p", "x", "d2", 0.5), ("b", "p", "x", "d1", 0.74)], CLAIMS)
    found = co.promotion_candidates(c)
    assert rows(found, "s", "final_confidence") == [("a", 0.75)]
    quads = c.select(F.lit("tentative").alias("graph"), "s", "p", "o", F.lit("literal").alias("o_kind"), "confidence")
    once = co.promote(quads, found)
    assert rows(co.promote(once, found), "graph", "s") == rows(once, "graph", "s")
    assert rows(co.promote(quads, found, move=True).where("graph = 'tentative'"), "s") == [("b",)]


def test_contradictions_and_penalty(spark):
    c = spark.createDataFrame([("a", "p", "x", "d1", 0.9), ("a", "p", "y", "d2", 0.9), ("b", "p", "x", "d1", 0.9)], CLAIMS)
    assert rows(co.contradictions(c), "s", "n") == [("a", 2)]
    assert rows(co.penalise(c, co.contradictions(c), penalty=0.1), "o", "after", "demoted") == [("x", 0.81, False), ("y", 0.81, False)]
    assert {r[2] for r in rows(co.penalise(c, co.contradictions(c)), "o", "after", "demoted")} == {True}
    assert rows(co.explain_conflicts(c), "sources") == [("d1,d2",)]


def test_gate_order_and_routing(spark):
    d = spark.createDataFrame([("x" * 10, "fr"), ("x" * 60, "fr"), ("x" * 60, "en"), ("x" * 9000, "en"), (None, "en"), ("x" * 60, None)], "text string, lang string")
    assert [r[0] for r in d.select(gate.gate_reason()).collect()] == ["too_short", "language", None, "too_long", "too_short", "language"]
    d = spark.createDataFrame([(0.75,), (0.35,), (0.3499,), (None,)], "confidence double")
    assert [r[0] for r in d.select(gate.route()).collect()] == ["trusted", "tentative", "discard", "discard"]


def test_names(spark):
    d = spark.createDataFrame([("http://a/b#cD",), ("http://a/birthDate",), ("kc:part_of",)], "x string")
    assert [tuple(r) for r in d.select(t.local_name("x"), t.label_of("x"), t.expand("x")).collect()] == [("cD", "c d", "http://a/b#cD"), ("birthDate", "birth date", "http://a/birthDate"), ("part_of", "part of", "http://kc.example/ns/part_of")]
    d = spark.createDataFrame([("kc:a",), ('"5"^^xsd:integer',), ('say "hi"',), ("http://x/y",)], "x string")
    assert [r[0] for r in d.select(t.encode_term("x")).collect()] == ["<http://kc.example/ns/a>", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', '"say \\"hi\\""', "<http://x/y>"]


def test_dates_and_durations(spark):
    d = spark.createDataFrame([("2024-03-01",), ("3/1/2024",), ("March 1, 2024",), ("no",)], "x string")
    assert [r[0] for r in d.select(t.iso_date("x")).collect()] == ["2024-03-01", "2024-03-01", "2024-03-01", None]
    d = spark.createDataFrame([("30d",), ("48h",), ("15m",), ("2",)], "x string")
    assert [r[0] for r in d.select(t.seconds_of("x")).collect()] == [2592000, 172800, 900, 172800]


def test_similarity():
    assert similarity.ratio_of("abc", "abc") == 1
    assert similarity.partial_of("bcd", "abcde") == 100
    assert similarity.token_sort_of("red widget", "Widget red") == 100


def test_components_and_closure(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert rows(gr.components(e), "iri", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "s string, o string")
    assert len(rows(gr.closure(cycle), "s", "o")) == 9


def test_long_path_is_one_component(spark):
    e = spark.range(200).select(F.format_string("%04d", "id").alias("a"), F.format_string("%04d", F.col("id") + 1).alias("b"))
    assert rows(gr.components(e).select("component").distinct(), "component") == [("0000",)]


def test_owl_rules(spark):
    q = spark.createDataFrame([("A", "rdfs:subClassOf", "B"), ("B", "rdfs:subClassOf", "C"), ("x", "rdf:type", "A"), ("near", "rdf:type", "owl:TransitiveProperty"), ("1", "near", "2"), ("2", "near", "3"), ("knows", "rdfs:domain", "P"), ("u", "knows", "v")], "s string, p string, o string")
    got = set(rows(gr.owl_closure(q), "s", "p", "o"))
    assert {("x", "rdf:type", "C"), ("A", "rdfs:subClassOf", "C"), ("1", "near", "3"), ("u", "rdf:type", "P")} <= got
    assert len(got) == len(q.collect()) + 5


def test_leader_and_centroid_clusters(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0)], "id long, embedding array<double>, block int")
    for centroid in (False, True):
        assert rows(greedy.leaders(d, 0.9, centroid=centroid), "id", "leader") == [(1, 1), (2, 1), (3, 3)]


def test_fragments(spark):
    text = "lost preamble\n# One\nfirst. second.\n```\n# not a heading\n```\n## Two\nthird.\n# Three\n   \n"
    d = spark.createDataFrame([("d", text), ("e", "plain"), ("f", "  ")], "source_iri string, text string")
    got = {(r.source_iri, r.fragment_key): r for r in tx.heading_fragments(d).collect()}
    assert set(got) == {("d", "One"), ("d", "One > Two"), ("d", "Three"), ("e", "root")}
    r = got["d", "One > Two"]
    assert text[r.char_start : r.char_end] == r.text == "## Two\nthird.\n"
    over = {r.fragment_key: r.text for r in tx.heading_fragments(d, overlap=1).where("source_iri = 'd'").collect()}
    assert over["Three"].startswith("## Two\nthird.") or over["Three"].startswith("third.")


def test_semantic_fragments(spark):
    d = spark.createDataFrame([("a", "One. Two."), ("b", "cat sat mat. cat sat mat. dog ran far. dog ran far."), ("c", None)], "source_iri string, text string")
    assert rows(tx.semantic_fragments(d), "source_iri", "fragment_key") == [("a", "semantic_chunk_0"), ("b", "semantic_chunk_0"), ("b", "semantic_chunk_1")]


def test_extraction_has_evidence(spark):
    d = spark.createDataFrame([("d", "root", "Ada is a poet. Bob has money.")], "source_iri string, fragment_key string, text string")
    got = tx.extract(d)
    assert rows(got, "s", "p", "o") == [("ex:Ada", "kc:isA", "poet"), ("ex:Bob", "kc:has", "money")]
    assert all(d.first().text[r.char_start : r.char_end] == r.excerpt for r in got.collect())
    assert tx.nothing(d).count() == 0


def test_decompose_and_rewrite(spark):
    d = spark.createDataFrame([("a", "population_2020", "5"), ("a", "name", "x")], "s string, p string, o string")
    assert rows(vo.decompose(d), "p", "o") == [("ex:year", "2020"), ("name", "x"), ("population", "5")]
    m = spark.createDataFrame([("a", "b")], "iri string, canonical string")
    assert rows(vo.rewrite(d, m), "s") == [("b",), ("b",)]


def test_matching_and_calibration(spark):
    e = spark.createDataFrame([("a", "p", "X!", 0.9, "d"), ("a", "p", "in 1990", 0.8, "d"), ("a", "p", "no", 0.1, "d")], "s string, p string, o string, confidence double, domain string")
    tr = spark.createDataFrame([("P1", "a", "x"), ("P1", "a", "1990-05-01")], "pid string, s string, o string")
    al = spark.createDataFrame([("P1", "p")], "pid string, predicate string")
    m = ev.matches(e, al, tr)
    assert rows(m, "o", "match_type") == [("X!", "exact"), ("in 1990", "exact"), ("no", "no_match")]
    assert rows(ev.calibration(m), "bucket", "n", "accuracy") == [("0.00-0.25", 1, 0.0), ("0.75-1.00", 2, 1.0)]
    assert rows(ev.pearson(ev.calibration(m)), "r") == [(1.0,)]
    assert rows(ev.pearson(ev.calibration(m).limit(1)), "r") == [(0.0,)]


def test_arguments_and_status(spark):
    a = spark.createDataFrame([("c", ["e"], [("o1", None), ("o2", "r")])], "claim string, evidence array<string>, objections array<struct<text:string,rebuttal:string>>")
    assert kn.unanswered(kn.argument_records(a)).count() == 1
    q = spark.createDataFrame([("a", "p", "x")], "s string, p string, o string")
    assert rows(kn.read_status(kn.annotate_status(q, F.lit("verified"))), "s", "status") == [("a", "verified")]
    m = spark.createDataFrame([("x", "deprecated", "verified"), ("x", None, "observed"), ("x", "extracted", "verified")], "subject string, from string, to string")
    assert rows(kn.valid_moves(m), "to", "valid") == [("observed", True), ("verified", False), ("verified", True)]


def test_shapes(spark):
    q = spark.createDataFrame([("a", "rdf:type", "C"), ("a", "n", "5"), ("b", "rdf:type", "C"), ("b", "n", "x"), ("b", "n", "50")], "s string, p string, o string")
    shapes = [("min", "C", "m", "minCount", "1"), ("max", "C", "n", "maxCount", "1"), ("num", "C", "n", "datatype", "xsd:integer"), ("le", "C", "n", "maxInclusive", "10")]
    got = rows(kn.violations(q, shapes), "shape", "focus")
    assert got == [("le", "b"), ("le", "b"), ("max", "b"), ("min", "a"), ("min", "b"), ("num", "b")]


def test_diff_dependencies_and_hashes(spark):
    a = spark.createDataFrame([("a", "p", "x"), ("b", "p", "x")], "s string, p string, o string")
    b = spark.createDataFrame([("a", "p", "x"), ("c", "p", "x")], "s string, p string, o string")
    assert rows(kn.semantic_diff(a, b), "s", "status") == [("a", "unchanged"), ("b", "removed"), ("c", "added")]
    d = kn.dependencies(spark.createDataFrame([("s", "p", "f1", "doc")], "s string, p string, fragment_key string, source_iri string"))
    left, events = kn.invalidated(d, spark.createDataFrame([("f1",)], "dep_ref string"))
    assert d.count() == 3 and left.count() == 0 and events.count() == 1
    f = spark.createDataFrame([("k", "1"), ("l", "2"), ("m", "3")], "fragment_key string, content_hash string")
    old = spark.createDataFrame([("k", "1"), ("l", "9")], "fragment_key string, content_hash string")
    assert rows(gate.hash_status(f, old), "fragment_key", "status") == [("k", "unchanged"), ("l", "changed"), ("m", "new")]
    assert {r[0] for r in rows(gate.hash_status(f, old, force=True).where("fragment_key = 'k'"), "status")} == {"changed"}


def test_json_ld_lists(spark):
    q = spark.createDataFrame([("a", "p", "1"), ("a", "p", "2"), ("a", "q", 'x"')], "s string, p string, o string")
    import json

    assert json.loads(kn.json_ld(q).first().doc) == {"@id": "a", "p": ["1", "2"], "q": 'x"'}


# pairs, skew, status, tuning: against loops over everything


def test_close_names_lose_no_pair(spark):
    import random

    r = random.Random(8)
    names = {"".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(120)}
    distance = lambda a, b: len(b) if not a else len(a) if not b else _edits(a, b)
    for most in (1, 3):
        got = {(x.a, x.b): x.distance for x in gr.close_names(spark.createDataFrame([(n,) for n in names], "name string"), most).collect()}
        assert got == {(a, b): distance(a, b) for a in names for b in names if a < b and distance(a, b) <= most}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    from lodestone.plans import lineage

    many = spark.range(300).select((F.col("id") % 10 * F.col("id") % 7).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("top"))
    want = rows(many.join(one, "k"), "k", "id", "top")
    monkeypatch.setattr(lineage, "LEAST_HOT", 20)
    for keys in (2, 8, 1000):
        monkeypatch.setattr(lineage, "HOT_KEYS", keys)
        assert rows(lineage.hot_join(many, one, "k", "c", 300), "k", "id", "top") == want


def test_components_with_a_hub(spark, monkeypatch):
    from lodestone.plans import lineage

    monkeypatch.setattr(lineage, "LEAST_HOT", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = dict(tuple(r) for r in gr.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(21)}


def test_statuses_of_pairs(spark):
    t3 = spark.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("b", "q", "x")], "s string, p string, o string")
    q = kn.annotate_status(t3, F.lit("extracted")).unionByName(kn.annotate_status(t3.where("s = 'a'"), F.lit("verified")))
    assert rows(kn.read_status(q), "s", "p", "status") == [("a", "p", "extracted"), ("a", "p", "verified"), ("b", "q", "extracted")]
    assert q.where("p = 'kc:onSubject'").count() == 3 and q.select("s").distinct().count() == 2


def test_last_hash_counts(spark):
    new = spark.createDataFrame([("k", "h2"), ("n", "h1"), ("c", "h3")], "fragment_key string, content_hash string")
    prior = spark.createDataFrame([("k", "h1", 1), ("k", "h2", 2), ("c", "h3", 1), ("c", "h4", 2)], "fragment_key string, content_hash string, at long")
    assert rows(gate.hash_status(new, prior), "fragment_key", "status") == [("c", "changed"), ("k", "unchanged"), ("n", "new")]


def test_predicates_are_collapsed_and_split(spark):
    q = [("kc:hasAuthor", 3), ("kc:has_author", 2), ("kc:author", 1), ("kc:size", 2), ("kc:founded_in_2019", 1)]
    df = spark.createDataFrame([("trusted", f"s{i}", p, f"o{i}", "literal", 0.5) for p, n in q for i in range(n)], "graph string, s string, p string, o string, o_kind string, confidence double")
    assert rows(vo.predicate_leaders(df), "iri", "canonical") == [("kc:author", "kc:hasAuthor"), ("kc:has_author", "kc:hasAuthor")]
    out = vo.normalise(df, canonical_predicates=spark.createDataFrame([("kc:size", "kc:extent")], "iri string, canonical string"))
    assert {r.p for r in out.collect()} == {"kc:hasAuthor", "kc:extent", "kc:founded", "ex:year"}
    year = out.where("p = 'ex:year'").first()
    assert (year.o, year.o_kind, year.graph) == ("2019", "literal", "trusted")


def test_answers_without_json_and_budgets(spark):
    from lodestone.operators import provider

    d = spark.createDataFrame([("no json at all",), (None,), ("[]",), ('{"other": 1}',)], "x string")
    assert [r[0] for r in d.select(F.size(provider.answered_triples("x"))).collect()] == [0, 0, 0, 0]
    system = "You extract facts.\n\nEXAMPLES:\n" + "an example\n" * 30 + "\nENTITY CATALOG:\n" + "an entity\n" * 10 + "\nEnd."
    s = spark.createDataFrame([(system, "a fragment")], "system string, fragment string")
    cut = lambda n: s.select(provider.within_budget("system", "fragment", n).alias("x")).first().x
    assert cut(1000) == system
    assert "EXAMPLES" not in cut(60) and "ENTITY CATALOG" in cut(60) and cut(60).endswith("End.")
    assert "ENTITY CATALOG" not in cut(20) and cut(20).startswith("You extract facts.")
    p = s.select(provider.prompt(("TASK:", F.lit("do")), ("NOTES:", F.lit(" ")), ("", F.col("fragment"))).alias("x")).first().x
    assert p == "TASK:\ndo\n\na fragment"
    assert provider.nested({"a.b": "1", "a.c.d": "2", "e": "3"}) == {"a": {"b": "1", "c": {"d": "2"}}, "e": "3"}


def test_distilling_by_strategy_and_section(spark):
    body = "# Life\nShe was born. She worked. She won. She died.\n# References\ngone\n# Odd\nnoise"
    d = spark.createDataFrame([(body,)], "text string")
    one = lambda *a, **k: d.select(tx.distilled("text", *a, **k).alias("x")).first().x
    assert one("skip") == body and one() == one("moderate") == one("unknown") == "# Life\nShe was born. She worked. She won. She died.\n# Odd\nnoise"
    assert one("moderate", model=lambda x, name: F.concat(name, F.lit("!"))) == "moderate!" and one("moderate", model=lambda x, name: F.lit(" ")) == one()
    assert one("section_aware", keep_sections={"life": "summarize", "odd": "remove"}) == "## Life\n\nShe was born. She worked. She won.\n\n## References\n\ngone"


def test_entities_of_an_evaluation(spark):
    subjects = spark.createDataFrame([("ex:Marie_Curie", "person"), ("http://x.example/y/pierre-curie", "person"), ("ex:Nobody", None)], "iri string, context string")
    candidates = spark.createDataFrame([("Curie Pierre", "Q2", "person"), ("Pierre Currie", "Q3", "place")], "label string, qid string, context string")
    got = rows(ev.resolved_entities(subjects, ("Marie Curie", "Q1"), candidates), "iri", "qid", "match_type", "confidence")
    assert got == [("ex:Marie_Curie", "Q1", "sitelink", 1.0), ("http://x.example/y/pierre-curie", "Q2", "label", 1.0)]
