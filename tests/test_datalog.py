"""Rules against loops over all facts; what each round reads."""

import random

import pytest

from lodestone.plans import datalog

PATHS = '?x up ?y :- ?x in ?y . ?x up ?z :- ?x up ?y, ?y up ?z .'.replace("up", "k:up").replace(" in ", " k:in ")


def facts(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string").repartition(3)


def closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recursive_paths(spark, seed):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(35)}
    seen = []
    got = datalog.infer(facts(spark, [(a, "k:in", b) for a, b in edges]), PATHS, seen=seen)
    assert {(x.s, x.o) for x in got.collect()} == closure(edges) and {x.p for x in got.collect()} == {"k:up"}
    assert got.count() == len(closure(edges)) == sum(n for *_, n in seen) and seen[-1][2] == 0


def test_a_round_reads_the_last_round_only(spark):
    chain = [(f"n{i:02d}", "k:in", f"n{i + 1:02d}") for i in range(20)]
    linear = "?x k:up ?y :- ?x k:in ?y . ?x k:up ?z :- ?x k:up ?y, ?y k:in ?z ."
    seen, read = [], []
    real = datalog.derived

    def counted(rule, sources, known):
        if len(sources) == 2:
            read.append(sources[0].count())
        return real(rule, sources, known)

    try:
        datalog.derived = counted
        got = datalog.infer(facts(spark, chain), linear, seen=seen)
    finally:
        datalog.derived = real
    assert got.count() == 210
    news = [n for *_, n in seen]
    assert news == [*range(20, 0, -1), 0] and read[1:] == news[:-1]


def test_negation_by_strata(spark):
    rows = [("a", "t", "C"), ("b", "t", "C"), ("c", "t", "C"), ("o1", "by", "a"), ("a", "bal", "5"), ("b", "bal", "50"), ("c", "bal", "x"), ("b", "near", "c"), ("c", "near", "a")]
    rows = [(s, "k:" + p, o) for s, p, o in rows]
    rules = """
    # who has nothing, and what follows from that
    ?c k:idle "yes" :- ?c k:t C, not ?o k:by ?c .
    ?c k:rich "yes" :- ?c k:bal ?v, ?v > 9 .
    ?c k:poor ?d :- ?c k:near ?d, not ?c k:rich "yes", not ?d k:idle "yes" .
    ?x k:chain ?y :- ?x k:near ?y .
    ?x k:chain ?z :- ?x k:chain ?y, ?y k:near ?z, ?x != ?z .
    """
    seen = []
    got = {(r.s, r.p[2:], r.o) for r in datalog.infer(facts(spark, rows), rules, seen=seen).collect()}
    assert got == {("b", "idle", "yes"), ("c", "idle", "yes"), ("b", "rich", "yes"), ("c", "poor", "a"), ("b", "chain", "c"), ("c", "chain", "a"), ("b", "chain", "a")}
    assert {s for s, *_ in seen} == {0, 1}


def test_variable_predicates_and_repeated_variables(spark):
    rows = [("p", "k:sub", "q"), ("a", "p", "b"), ("a", "p", "a"), ("x", "k:same", "x")]
    rules = "?s ?q ?o :- ?s ?p ?o, ?p k:sub ?q . ?x k:loop ?p :- ?x ?p ?x ."
    got = {tuple(r) for r in datalog.infer(facts(spark, rows), rules).collect()}
    assert got == {("a", "q", "b"), ("a", "q", "a"), ("a", "k:loop", "p"), ("a", "k:loop", "q"), ("x", "k:loop", "k:same")}


@pytest.mark.parametrize("text", ["?x k:a ?y :- not ?x k:b ?y .", "?x k:a ?z :- ?x k:b ?y .", "?x k:a ?x :- ?x k:b ?y, not ?x k:a ?y .", "?x k:a ?y ?x k:b ?y .", "?x k:a :- ?x k:b ?y .", "?x k:a ?y :- ?x k:b ?y", "?x k:a ?y :- ?x k:b ?y, ?z > 3 .", "@"])
def test_refused(text):
    with pytest.raises(datalog.DatalogError):
        datalog.strata(datalog.parse(text))


def test_cross_joins_are_refused_and_nothing_is_found_in_nothing(spark):
    with pytest.raises(datalog.DatalogError):
        datalog.infer(facts(spark, [("a", "k:b", "c")]), "?x k:a ?y :- ?x k:b ?z, ?y k:c ?w .")
    assert datalog.infer(facts(spark, [("a", None, "c")]).limit(0), PATHS).count() == 0
    assert datalog.infer(facts(spark, [("a", None, "c"), (None, "k:in", "b")]), PATHS).count() == 0
