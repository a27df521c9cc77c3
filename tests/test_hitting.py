"""Minimal hitting sets against enumeration."""

import random
from itertools import combinations

import pytest

from lodestone.operators import consolidate as co


def enumerated(sets):
    names = sorted(set().union(*sets)) if sets else []
    for k in range(len(names) + 1):
        for c in combinations(names, k):
            if all(set(c) & s for s in sets):
                return c
    return ()


@pytest.mark.parametrize("seed", range(6))
def test_equals_enumeration(seed):
    r = random.Random(seed)
    for _ in range(150):
        n = r.randint(1, 8)
        sets = [frozenset(r.sample("abcdefgh"[:n], r.randint(1, min(n, 4)))) for _ in range(r.randint(0, 8))]
        assert co.minimal_hitting_set(sets) == enumerated(sets)


def test_greedy_is_not_enough():
    # the greedy choice takes the name in most sets first, and needs three
    sets = [frozenset(x) for x in ("ab", "ac", "ad", "be", "ce", "df", "bf", "cf")]
    assert co.minimal_hitting_set(sets) == enumerated(sets)


def test_conflicts(spark):
    rows = [("x", "p", "1", "a"), ("x", "p", "1", "b"), ("x", "p", "2", "b"), ("x", "p", "3", "c"), ("x", "p", "3", "c"), ("y", "p", "1", "a"), ("y", "p", "2", None), ("z", "p", "1", "a"), ("w", "p", "1", "m"), ("w", "p", "2", "n"), ("w", "p", "1", "n")]
    d = spark.createDataFrame(rows, "s string, p string, o string, source_iri string")
    assert {(r.s, r.sources) for r in co.explain_conflicts(d).collect()} == {("x", "b,c"), ("y", "a"), ("w", "n")}
    assert co.explain_conflicts(d.limit(0)).count() == 0
