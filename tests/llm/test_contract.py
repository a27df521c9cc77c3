"""Contract queries against brute force, and on rows that are hard to treat."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

from lodestone.llm import queries as Q, sql
from lodestone.llm.langid import predict, train

from . import brute

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
COLUMNS = {
    "op2": ("n_shingles", "component_id", "kept"),
    "op3": ("n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op5": ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "op6": ("n_words", "n_removed", "kept_sha256"),
    "op8": ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op10": ("n_assign", "n_access", "n_hex", "base_sha256"),
    "op13": ("n_lines", "n_dropped", "kept_sha256"),
    "op11": ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"),
}


def query(op):
    return next(f for name, f in Q.QUERIES.items() if name.startswith(op + "_"))


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("etaoinshrdlé", k=r.randint(1, 9))) for _ in range(n)]


def sample():
    """Copies, near copies, shared passages, tiny and long texts, odd bytes, secrets and null."""
    base = words(1, 300)
    passage = " ".join(words(2, 120))
    texts = [None, "", "  \n\t ", "one", "ONE", "one two", " ".join(base), " ".join(base), " ".join(base[:150] + ["new"] + base[151:]), " ".join(base[:-40]), " ".join(base[60:])]
    texts += [f"{' '.join(words(9 + i, 40))} {passage} {' '.join(words(50 + i, 40))}" for i in range(4)]
    texts += ["a" * 2000, "ab " * 3000, " ".join(words(3, 20000)), "x\x1cy\x85z w " * 30, "same line.\nsame line.\nother\n" * 20]
    texts += ['token = "abcdef123" PASSWORD:hunter22 AKIA' + "A1" * 10 + " " + "0a" * 14, "toKen=short password = x secreT: 'abc' apikey=ABCDEF== Key", f"{passage} {passage}"]
    return [(i, t, ("en", "fr")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


ITEMS = [(1, " ".join(words(2, 120)[:12])), (2, "one"), (3, None), (4, "..."), (5, " ".join(words(2, 120)[40:50]).upper()), (6, "never seen " * 8)]


def folder(spark, path, rows, items=ITEMS):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("small"), sample())


@pytest.mark.parametrize("op", COLUMNS)
def test_equals_brute_force(spark, small, op):
    docs = [r[:2] for r in sample()]
    want = getattr(brute, op)(docs, ITEMS) if op == "op8" else getattr(brute, op)(docs)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS[op]) for r in query(op)(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("op", ["op3", "op5", "op6", "op10", "op11", "op13"])
def test_equals_brute_force_on_test_data(spark, sf_dir, op):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS[op]) for r in query(op)(spark, sf_dir).collect()}
    assert got == getattr(brute, op)(docs)


@pytest.mark.parametrize("name", sql.ORACLE)
def test_equals_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql.ORACLE[name])
    df = Q.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_scores(spark, small):
    want = brute.op7([r[:2] for r in sample()])
    for r in query("op7")(spark, small).collect():
        *exact, base, score = want[r.doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, rel=0.002)


def test_scores_beat_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in query("op7")(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packing(spark, small, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = [(99, "<|endoftext|> A<|startoftext|>b <|ENDOFTEXT|>. İß don't it's. $.,", "en", "s", 0)]
    for d, extra in ((small, []), (sf_dir, [])):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()] + extra
        brute.op9(docs, [tuple(r) for r in query("op9")(spark, d).collect()], tokenizer)
    from lodestone.llm import pack

    out = pack.pack(spark.createDataFrame(special, DOCS), length=8, with_ids=True).orderBy("start").collect()
    assert [i for r in out for i in r.ids] == [*tokenizer.encode(special[0][1], add_special_tokens=False).ids, 2]


def test_languages(spark, sf_dir, small):
    both = query("op4")(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = both.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 20 and held[0] > 0.95
    got = {r.doc_id: r for r in query("op4")(spark, small).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[3].lang_pred in ("en", "fr")


def test_languages_equal_brute_force(spark, small, sf_dir):
    docs = [r[:3] for r in sample()] + [(100 + i, t, lang) for i, (t, lang) in enumerate([("Été à la 3e-plage!! ", "fr"), ("ÀB", None), ("x" * 300, "en"), ("12 34", "en"), ("İx ß", "fr")])]
    d = spark.createDataFrame([(*r, "s", 0) for r in docs], DOCS)
    d = d.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars").toDF(*d.columns))
    want = brute.op4([tuple(r) for r in d.select("doc_id", "text", "lang").collect()])
    from lodestone.llm.langid import held_out

    got = predict(d, train(d.where(~held_out()))).collect()
    assert len(got) == len(want)
    for r in got:
        _, lang, score = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=2e-3)
        assert r.lang_pred == lang or score < 0.51


def test_no_labels_give_und(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    model = train(d.withColumn("lang", F.lit(None).cast("string")))
    assert [tuple(r) for r in predict(d, model).collect()] == [(1, "und", 0.0)]


@pytest.mark.parametrize("name", Q.QUERIES)
def test_empty_tables(spark, tmp_path, name):
    d = folder(spark, tmp_path, [], [])
    assert Q.QUERIES[name](spark, d).count() == 0


@pytest.mark.parametrize("name", Q.QUERIES)
def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path, name):
    rows = [(None, "some words here. " * 20, None, None, None), (None, None, "en", None, None), *[(7, "some words here. " * 20, "en", "s", 1)] * 3, (7, "others", None, "s", 1), (8, "some words here. " * 20, "en", "s", 1)]
    d = folder(spark, tmp_path, rows)
    clash = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as n_words", "true as kept", "'x' as _gone", "2 as row", "3 as n", "'k' as value", "4 as held_out", "'z' as _w")
    clash.write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/more/benchmark.parquet")
    for at in (d, f"{tmp_path}/more"):
        got = Q.QUERIES[name](spark, at)
        if name == "decontamination_proximity":
            assert got.count() == 0
        elif name.startswith("op9"):
            assert {(r.doc_id, r.doc_tokens) for r in got.collect() if r.start == 0} >= {(None, 1), (8, 81)}
        else:
            assert got.count() == len(rows) and got.where("doc_id IS NULL").count() == 2
