"""Pairs that a block or a shared word would lose, answers as models write them, and plans without text functions in lambdas."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.functions.similarity import token_sort_of
from lodestone.functions.terms import evaluation_label
from lodestone.operators import corpus, evaluate as ev, gate, provider


def test_catalog_equals_a_loop(spark):
    r = random.Random(2)
    base = ["".join(r.choices("abcde", k=r.randint(3, 7))).title() for _ in range(12)]
    names = [f"{r.choice(base)} {r.choice(base)}" for _ in range(40)]
    names += [" ".join(reversed(n.split())) for n in names[:20]] + [n[1:] for n in names[20:30]] + ["ab", "---"]
    rows = [(n, i) for i, n in enumerate(names) for _ in range(r.randint(1, 4))]
    got = corpus.catalog(spark.createDataFrame(rows, "mention string, i long").repartition(3), most=20).collect()
    counts = {}
    for n, _ in rows:
        counts[n] = counts.get(n, 0) + 1
    top = sorted(counts, key=lambda n: (-counts[n], n))[:40]
    groups = []
    for n in top:
        home = next((g for g in groups if token_sort_of(n, g[0]) > 85), None)
        if home is None:
            groups.append([n])
        else:
            home.append(n)
    assert [(x.canonical, x.aliases, x.n) for x in got] == [(g[0], g[1:], sum(counts[n] for n in g)) for g in groups[:20]]
    assert all(re.fullmatch("[a-z0-9-]+", x.canonical_name) for x in got)
    assert corpus.catalog(spark.createDataFrame([], "mention string")).count() == 0


def test_every_candidate_is_compared(spark):
    r = random.Random(5)
    iris = ["ex:Einstien", "ex:Marie_Curie", "ex:curie_marie", "ex:Nobody_Known", "ex:Bohr", *("ex:" + "".join(r.choices("abcdef_", k=9)) for _ in range(30))]
    labels = ["Einstein", "Marie Curie", "Niels Bohr", "Bohr", "bohr", *("".join(r.choices("abcdef ", k=9)) for _ in range(60))]
    subjects = spark.createDataFrame([(i, "person" if k % 2 else None) for k, i in enumerate(iris)], "iri string, context string")
    candidates = spark.createDataFrame([(n, f"Q{k:02d}", "person") for k, n in enumerate(labels)], "label string, qid string, context string")
    got = {x.iri: (x.qid, x.match_type, x.confidence) for x in ev.resolved_entities(subjects, ("Marie Curie", "Q99"), candidates).collect()}
    named = {x.iri: (x.label, x.context) for x in subjects.select("iri", "context", evaluation_label("iri").alias("label")).collect()}
    want = {}
    for iri, (label, context) in named.items():
        if label.lower().strip() == "marie curie":
            want[iri] = ("Q99", "sitelink", 1.0)
            continue
        score, qid = max(((token_sort_of(label, n), f"Q{k:02d}") for k, n in enumerate(labels)), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if score >= 80:
            want[iri] = (qid, "label" if score == 100 else "fuzzy_label", round(min(1, score / 100 + 0.05 * (context == "person")), 6))
    assert got == want and got["ex:Einstien"][:2] == ("Q00", "fuzzy_label") and got["ex:Bohr"][0] == "Q03" and "ex:Nobody_Known" not in got


@pytest.mark.parametrize(("answer", "want"), [
    ('[{"subject":"a","predicate":"b","object_value":"c","confidence":"0.5"}]', [0.5]),
    ('{"triples":[{"subject":"a","predicate":"b","object_value":"c","confidence":1},{"subject":"a","predicate":"b","object_value":"c","confidence":"high"}]}', [1.0, None]),
    ('text "subject": "a", "predicate": "b", "object_value": "c", "confidence": 0.7', [0.7]),
    ('{"foo": []}', []),
])
def test_confidences_as_models_write_them(spark, answer, want):
    t = spark.createDataFrame([(answer,)], "x string").select(provider.answered_triples("x").alias("t")).first().t
    assert [x.confidence for x in t] == want


def test_mentions(spark, tmp_path):
    texts = ["Something big. SOMETHING else, sométhing; nonsensical nonsense abcdefgh", None, "", "short words only", "x" * 40 + " tail " + "x" * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.source_iri, x.o): (x.char_start, x.char_end, x.excerpt) for x in fx.mentions(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for o in set(re.findall("[a-z]{8,}", (t or "").lower())):
            at = t.lower().index(o)
            want[f"doc:{i}", o] = (at, at + len(o), t[at : at + 30])
    assert got == want and {(x.source_iri, x.o) for x in fx.mentions(spark, str(tmp_path), places=False).collect()} == set(want)


def test_no_text_function_runs_once_a_token(spark, sf_dir):
    for d in (fx.mentions(spark, sf_dir), gate.top_per_fragment(fx.mentions(spark, sf_dir, places=False), 5), fx.claims(spark, sf_dir)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        for lambdas in re.findall(r"lambdafunction\((.*)", plan):
            assert "lower(" not in lambdas and "instr(" not in lambdas and "regexp" not in lambdas
        assert not re.search(r"size\(.*regexp", plan)


def test_grounding_keeps_each_mention(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "source_iri string, text string")
    m = spark.createDataFrame([("a", "two", 1), ("a", "three", 2), ("b", "x", 3), ("a", "", 4)], "source_iri string, excerpt string, k int")
    assert {(r.k, r.grounded) for r in gate.grounding(m, docs).select("k", F.col("grounded")).collect()} == {(1, True), (2, False), (3, False), (4, False)}
