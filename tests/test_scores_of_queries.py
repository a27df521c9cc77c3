"""Queries whose scores SQL cannot express, against plain loops over the same rows."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone import fixtures as fx, queries
from lodestone.functions.terms import bare
from lodestone.sources import files


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_fn29_ratio(spark, sf_dir):
    names = {r[0] for r in fx.read(spark, sf_dir, "part").select("p_name").collect()}
    got = {r.p_name: r.x for r in queries.QUERIES["fn29_ratio"](spark, sf_dir).collect()}
    assert got == {n: round(ratio(n, "red widget"), 6) for n in names} and len(got) > 20


def test_tk08_fuzzy_ranking(spark, sf_dir):
    def partial(a, b):
        a, b = sorted((a, b), key=len)
        starts = {0, *(max(0, m.b - m.a) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())}
        return 100.0 if a in b else 100 * max(ratio(a, b[s : s + len(a)]) for s in starts)

    def weighted(a, b):
        a, b = a.lower(), b.lower()
        tokens = lambda x: " ".join(sorted(x.split()))
        return max(100 * ratio(a, b), 95 * ratio(tokens(a), tokens(b)), 0.9 * partial(a, b))

    names = {r[0] for r in fx.read(spark, sf_dir, "part").select("p_name").collect()}
    want = sorted(((n, weighted(n, "small ring")) for n in names), key=lambda x: (-round(x[1], 3), x[0]))
    want = [(n, s) for n, s in want if s >= 80][:20]
    got = [(r.p_name, r.score) for r in queries.QUERIES["tk08_fuzzy_ranking"](spark, sf_dir).collect()]
    assert {n for n, _ in got} == {n for n, _ in want} and got
    assert all(abs(s - dict(want)[n]) < 1e-3 for n, s in got) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_jn12_greedy_match(spark, sf_dir):
    rows = lambda d: [tuple(r) for r in d.select("s", "p", bare("o").alias("o")).collect()]
    left, right = {}, {}
    for side, d in ((left, fx.extracted(spark, sf_dir)), (right, queries.truth_quads(spark, sf_dir))):
        for s, p, o in rows(d):
            side.setdefault((s, p), []).append(o)
    found = {}
    for key, xs in left.items():
        ys = list(right.get(key, []))
        for score, x, y in sorted(((-round(ratio(x, y), 6), x, y) for x in set(xs) for y in set(ys))):
            while -score >= 0.9 and x in xs and y in ys:
                xs.remove(x), ys.remove(y)
                found.setdefault(key[1], []).append(-score)
    got = {r.p: (r.n, r.score) for r in queries.QUERIES["jn12_greedy_match"](spark, sf_dir).collect()}
    assert got.keys() == found.keys() and got
    assert all(got[p][0] == len(v) and abs(got[p][1] - sum(v) / len(v)) < 1e-4 for p, v in found.items())


def test_pf08_grounding_fuzzy(spark, sf_dir):
    texts = {r.source_iri: r.text for r in queries.documents(spark, sf_dir).select("source_iri", "text").collect()}
    counts = {True: 0, False: 0}
    for m in fx.mentions(spark, sf_dir).select("source_iri", "excerpt").collect():
        counts[m.excerpt in texts[m.source_iri]] += 1
    got = {r.grounded: r.n for r in queries.QUERIES["pf08_grounding_fuzzy"](spark, sf_dir).collect()}
    assert counts[False] == 0 and got == {True: counts[True]}  # all of these excerpts are there word for word
    docs = spark.createDataFrame([("a brown fox jumps over it",), ("entirely other",)], "text string")
    scores = [r[0] for r in docs.select(queries.partial_ratio(F.lit("brown fix jump"), F.col("text"))).collect()]
    assert abs(scores[0] - 100 * ratio("brown fix jump", "brown fox jump")) < 0.01 and scores[1] < 60


def test_wn03_heading_paths(spark, sf_dir):
    rows = files.sections(fx.read(spark, sf_dir, "pages")).orderBy("page_id", "idx").collect()
    want, stack, page = {}, [], None
    for r in rows:
        if r.page_id != page:
            stack, page = [], r.page_id
        stack = [(d, h) for d, h in stack if d < r.depth] + [(r.depth, r.heading)]
        want[r.page_id, r.idx] = " > ".join(h for _, h in stack)
    got = {(r.source_iri, r.idx): r.path for r in queries.QUERIES["wn03_heading_paths"](spark, sf_dir).collect()}
    assert got == want and got
