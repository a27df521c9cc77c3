"""Periodic runs against a count of every period, and on texts that are hard for hashes and for stacks."""

import random

import pytest

from lodestone.llm import periodic

from . import brute


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    r = random.Random(letters)
    for _ in range(250):
        n = r.randint(0, 90)
        x = [r.randrange(letters) for _ in range(n)]
        if n > 4 and r.random() < 0.5:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
        for least in (2, 12):
            assert sorted(periodic.runs_of(x, least)) == brute.runs_of(x, least)


def test_hashes_that_err_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic.Lce, "alike", lambda self, i, j, k: (i + j + k) % 3 != 0)
    r = random.Random(7)
    for _ in range(200):
        x = [r.randrange(2) for _ in range(r.randint(0, 60))] * r.randint(1, 2)
        assert sorted(periodic.runs_of(x, 2)) == brute.runs_of(x, 2)


@pytest.mark.parametrize("kind", ["one word", "long period", "words of Fibonacci", "words of Thue"])
def test_long_texts_take_little_time(kind):
    n = 60_000
    a, b, t = [0], [0, 1], [0]
    while len(b) < n:
        a, b = b, b + a
    while len(t) < n:
        t = t + [1 - v for v in t]
    x = {"one word": [0] * n, "long period": (list(range(9000)) * 8)[:n], "words of Fibonacci": b[:n], "words of Thue": t[:n]}[kind]
    lce = []
    real = periodic.Lce.forward
    count = lambda self, i, j: lce.append(1) or real(self, i, j)
    try:
        periodic.Lce.forward = count
        found = periodic.runs_of(x)
    finally:
        periodic.Lce.forward = real
    assert len(found) < n and len(lce) < 12 * n
    assert all(x[s : s + m - q] == x[s + q : s + m] for s, m, q in random.Random(1).sample(sorted(found), min(200, len(found))))


def test_general_form(spark):
    rows = [(1, "a b a b a b", "x"), (2, None, None), (2, "", "y"), (None, " \n ", "z"), (4, "p q " + "r s t " * 4 + "u", None)]
    docs = spark.createDataFrame(rows, "id long, body string, runs string")
    got = periodic.scan(docs, keep=("id", "runs"), least=6, column="body").collect()
    assert [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 6, [(0, 6, 2)], "a b"), (2, 0, [], ""), (2, 0, [], ""), (None, 0, [], ""), (4, 15, [(2, 12, 3)], "p q r s t u"),
    ]


def test_texts_beyond_a_chunk(spark):
    text = " ".join(map(str, range(150_000))) + " x y z" * 100_000
    got = periodic.scan(spark.createDataFrame([(1, "a b " * 10), (2, text), (3, None)], "doc_id long, text string")).collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 20, 2)], [(150_000, 300_000, 3)], []]
