"""What must not grow with the input: tasks that take whole groups, work done again, differences on odd rows."""

import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import fixtures as fx, queries
from lodestone.operators import coreference, evaluate as ev, graph as gr, knowledge as kn, provider, text as tx, vocab as vo
from lodestone.plans import lineage


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_greedy_match_sends_many_keys_in_a_batch(spark):
    kind = "s string, p string, o string"
    left = spark.createDataFrame([("a", "p", "x"), ("a", "p", "x"), ("a", "p", "abcdefghijk!"), ("b", "p", "y"), (None, "p", "z"), ("c", "p", "w")], kind)
    right = spark.createDataFrame([("a", "p", "x"), ("a", "p", "abcdefghijk"), ("b", "p", "q"), (None, "p", "z")], kind)
    found = ev.fuzzy_pairs(left, right, 0.8)
    assert "CoGroups" not in plan(found) and "MapInArrow" in plan(found)
    got = sorted((r.s or "-", r.truth) for r in found.collect() if r.score >= 0.8)
    assert got == [("-", "z"), ("a", "abcdefghijk"), ("a", "x")] and found.count() == 3


def test_candidate_tokens_of_texts_without_any(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, "12 34"), (3, None), (4, "b a-b a_1"), (5, "日本")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create table documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(queries.ORACLE["tk09_candidate_tokens"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["tk09_candidate_tokens"](spark, str(tmp_path)).collect())) == want and want[0] == (1, None)


def test_mentions_shuffle_nothing(spark, sf_dir):
    assert "Exchange" not in plan(fx.mentions(spark, sf_dir))


def test_first_places():
    text = "Über reclassification, classification reclassified classification CLASSIFIED " + "z" * 3000 + " zzzzzzzzz"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    tokens = {"reclassification", "classification", "reclassified", "classified", "z" * 3000, "z" * 9}
    assert fx.first_places(text) == {x: low.index(x) for x in tokens}
    assert fx.first_places("") == {} and fx.first_places("Kelvinscale") == {"elvinscale": 1}


def test_categories_that_most_rows_have_are_joined_where_they_are(spark):
    quads = spark.range(5000).select(F.lit("g").alias("graph"), F.concat(F.lit("s"), "id").alias("s"), F.when(F.col("id") == 7, None).otherwise(F.lit("p")).alias("p"), F.when(F.col("id") == 0, "one").when(F.col("id") == 1, None).otherwise(F.lit("many")).alias("o"), F.when(F.col("id") == 2, "iri").when(F.col("id") != 3, "literal").alias("o_kind"), F.lit(1.0).alias("confidence"))
    done = vo.promote_categorical(quads)
    assert "LeftAnti" in plan(done)
    got = {r.s: (r.o, r.o_kind) for r in done.collect()}
    assert len(got) == 5000 and got["s0"] == ("one", "literal") and got["s1"] == (None, "literal") and got["s2"] == ("many", "iri") and got["s3"] == ("many", None) and got["s7"] == ("many", "literal")
    assert all(v[0].startswith(vo.VOCAB) and v[1] == "iri" for k, v in got.items() if k not in ("s0", "s1", "s2", "s3", "s7"))


def test_numbering_by_ranges(spark, sf_dir):
    rows = lineage.numbered(spark.range(10000).select((F.col("id") * 7919 % 10007).alias("x")), "x")
    assert [(r.x, r.place) for r in rows.orderBy("x").collect()] == [(x, i + 1) for i, x in enumerate(sorted(i * 7919 % 10007 for i in range(10000)))]
    assert rows.limit(0).count() == 0 and lineage.numbered(spark.range(0), "id").count() == 0
    assert "SinglePartition" not in plan(queries.QUERIES["gr22_known_context"](spark, sf_dir))


def test_known_context_reads_only_lines_that_may_fit(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "f").alias("fragment_key"), F.concat(F.lit("i"), "id").alias("iri"), F.lit("l").alias("label"), F.lit("p").alias("property"), F.lit("v").alias("value"), F.col("id").alias("place"))
    done = provider.known_graph_context(rows, 60)
    assert "WindowGroupLimit" in plan(done)
    assert sorted((r.fragment_key or "", r.n_found, r.n_lines, r.words) for r in done.collect()) == [("", 2500, 8, 58), ("f", 2500, 8, 58)]


def test_partitions_grow_with_rows(spark, monkeypatch):
    assert lineage.parts(spark.range(1), 5_000_000, 500_000) == 11 and lineage.parts(spark.range(1), 0, 10) == 4
    quads = spark.createDataFrame([("a", 0.5), ("b", 0.6), (None, 0.7)], "s string, confidence double")
    bad = spark.createDataFrame([("a",)], "focus string")
    monkeypatch.setattr(kn, "parts", lambda *_: 9)
    assert ", 9)" in plan(kn.shape_penalty(quads, bad)) and sorted(r.confidence for r in kn.shape_penalty(quads, bad).collect()) == [0.35, 0.6, 0.7]
    monkeypatch.setattr(coreference, "PART", 30)
    texts = spark.createDataFrame([(i, f"Mrs Smith{i} is here. She is new.") for i in range(10)], "id int, text string")
    done = coreference.resolve(texts, "rules")
    size = sum(len(f"Mrs Smith{i} is here. She is new.") for i in range(10))
    assert re.search(rf"hashpartitioning\(_text_key#\d+, {1 + size // 30}\)", plan(done))
    assert {r.text for r in done.collect()} == {f"Mrs Smith{i} is here. Mrs Smith{i} is new." for i in range(10)}


def test_texts_keep_their_partitions(spark, monkeypatch):
    rows = [(i, f"Mrs Smith{i} is here. She is new.") for i in range(10)]
    monkeypatch.setattr(coreference, "PART", sum(len(t) for _, t in rows) // 3)  # 4, the session's number
    done = coreference.resolve(spark.createDataFrame(rows, "id int, text string"), "rules")
    assert re.search(r"hashpartitioning\(_text_key#\d+, 5\), REPARTITION_BY_NUM", plan(done))
    assert {r.text for r in done.collect()} == {f"Mrs Smith{i} is here. Mrs Smith{i} is new." for i in range(10)}


def test_answers_are_read_once(spark):
    rows = spark.createDataFrame([("x",)], "answer string").select(F.explode_outer(provider.answered_triples("answer")).alias("t"))
    assert plan(rows, "optimizedPlan").count("(?:json)?") <= 2


def test_decomposed_facts_are_worked_out_once(spark):
    rows = spark.createDataFrame([("s", "kc:a", "o")], "s string, p string, o string")
    assert "size(" not in plan(vo.decompose(rows), "optimizedPlan")


def test_rows_of_a_small_file_are_spread(spark, sf_dir):
    assert lineage.spread(spark.range(100), "id", 10).rdd.getNumPartitions() == 11
    for name in ("fn36_answers", "tx19_decompose"):
        assert "REPARTITION_BY_NUM" in plan(queries.QUERIES[name](spark, sf_dir))


def test_claims_of_a_document_are_combined_where_they_are(spark, sf_dir):
    for name in ("ag01_noisy_or", "tk05_consolidated_order"):
        sent = re.findall(r"hashpartitioning\(([^)]*)\)", plan(queries.QUERIES[name](spark, sf_dir), "optimizedPlan") + plan(queries.QUERIES[name](spark, sf_dir)))
        assert sent and not any("source_iri" in x for x in sent)


def test_claims_of_documents_with_one_id_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aaaa bbbb", "x"), (1, "aaaa cccc", "x"), (2, "aaaa aaaa", "x"), (None, "aaaa", "x"), (None, "aaaa", "x"), (3, None, "x"), (4, "aaaa", None)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create table documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    text = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    want = con.sql(queries.ORACLE["ag01_noisy_or"]).fetchall()
    got = queries.QUERIES["ag01_noisy_or"](spark, str(tmp_path)).select("s", "p", "o", "final_confidence", "n_sources").collect()
    assert text(map(tuple, got)) == text(want) and len(want) == 4


def test_semantic_fragments_take_a_batch_in_slices(spark):
    batch = pa.record_batch({"source_iri": [str(i) for i in range(300)], "text": [None if i == 5 else "x" * (i % 7) * 40_000 for i in range(300)]})
    found = list(tx.slices(batch))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert all(s.num_rows == 1 or (s.num_rows <= 64 and sum(len(t or "") for t in s.column(1).to_pylist()) <= 1 << 20) for s in found)
    d = spark.createDataFrame([(1, "A b. A b. A b. C d! E f?"), (2, None), (3, "One two. Three.")], "source_iri long, text string")
    done = tx.semantic_fragments(d)
    assert "MapInArrow" in plan(done)
    assert [tuple(r) for r in done.orderBy("source_iri", "fragment_key").collect()] == [("1", "semantic_chunk_0", "A b. A b. A b."), ("1", "semantic_chunk_1", "C d! E f?"), ("3", "semantic_chunk_0", "One two. Three.")]


def test_pairs_by_rank_are_joined_with_nothing(spark):
    edges = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "z"), ("q", "x"), ("q", "y"), ("q", "y"), ("r", "x"), ("w", "w")], "a string, b string")
    labels = spark.createDataFrame([("p", "L"), ("q", "l"), ("q", "M"), ("r", "l"), ("r", "m"), ("w", "l")], "iri string, label string")
    done = gr.rank_duplicates(gr.page_rank(edges, 3), labels, edges)
    assert plan(done, "optimizedPlan").count("Join") == 1
    got = sorted((min(r.a, r.b), max(r.a, r.b), r.label, r.similarity) for r in done.collect())
    assert got == [("p", "q", "l", 0.666667), ("q", "r", "l", 0.5), ("q", "r", "m", 0.5)]
    ranks = {r.iri: round(r["rank"], 6) for r in gr.page_rank(edges, 2).collect()}
    assert ranks["p"] == 0.15 and ranks["w"] == 1.0 and ranks["x"] == round(0.15 + 0.85 * (0.05 + 0.075 + 0.15), 6)


def test_fragments_of_blank_texts_and_of_documents_with_one_id(spark, tmp_path):
    texts = ["plain", "", "  ", "\n\n\t \r\f\n", None, "\u00a0\u3000", "\x0b", "\u2028", "\u200b", "a\n```\n# x\n```\n# y\n", "\r\n# cr\r# cr"]
    rows = [*enumerate(texts), (20, "one"), (20, "one"), (20, "two\n# x"), (20, ""), (None, "no id"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create table documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(queries.ORACLE["tx01_heading_fragments"]).fetchall(), key=repr)
    assert sorted(map(tuple, queries.QUERIES["tx01_heading_fragments"](spark, str(tmp_path)).collect()), key=repr) == want
    assert want.count((20, 2)) == 3 and want.count((None, 2)) == 2 and len(want) == 11


def test_heading_fragments_keep_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([("d", "# A\none.\n## B\ntwo."), ("d", "# C\nthree."), (None, "# D\nfour."), (None, "five")], "source_iri string, text string")
    found = tx.heading_fragments(docs, overlap=1)
    assert "Exchange" not in plan(found)
    got = sorted((r.source_iri or "-", r.fragment_key, r.heading_depth, r.char_start, r.char_end, r.text) for r in found.collect())
    assert got == [("-", "D", 1, 0, 9, "# D\nfour."), ("-", "root", 0, 0, 4, "five"), ("d", "A", 1, 0, 9, "# A\none.\n"), ("d", "A > B", 2, 9, 18, "# A\none.\n## B\ntwo."), ("d", "C", 1, 0, 10, "# C\nthree.")]
