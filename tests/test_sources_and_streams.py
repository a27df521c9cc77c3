import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, store
from lodestone.streaming import streams


def test_discover_parse_and_bank(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nhi")
    (tmp_path / "sub" / "b.markdown").write_text("plain")
    (tmp_path / "c.html").write_text("<p>x <b>y</b></p><script>no</script>")
    (tmp_path / "d.bin").write_bytes(b"\xff")
    found = files.discover(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["a.md", "b.markdown"]
    html = files.parse(files.discover(spark, str(tmp_path), ("*.html",)))
    assert html.first().text == "x y"
    bank = tmp_path / "bank"
    files.write_bank(spark.createDataFrame([("s", "p", "o", 0.9, "e", None)], "subject string, predicate string, object_value string, confidence double, excerpt string, reviewer_note string"), str(bank))
    (bank / "part-x.json").write_text("not json\n")
    assert files.read_bank(spark, str(bank)).count() == 1
    (tmp_path / "t.yaml").write_text("triples:\n- {subject: a, predicate: p, object_value: x, confidence: 0.5}\n")
    assert files.read_yaml_triples(spark, [str(tmp_path / "t.yaml")]).first().confidence == 0.5


def test_store_is_keyed_and_cleared_by_graph(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "quads"))
    q = spark.createDataFrame([("g1", "a", "p", "x", "iri", 0.5), ("g2", "a", "p", "x", "iri", 0.5)], "graph string, s string, p string, o string, o_kind string, confidence double")
    s.load(q)
    s.load(q.withColumn("confidence", F.lit(0.9)).where("graph = 'g1'"))
    s.load(q)
    assert s.count() == 2 and s.read("g1").first().confidence == 0.9 and s.read("g2").first().confidence == 0.5
    s.clear("g1")
    assert s.count("g1") == 0 and s.count() == 1
    assert "PartitionFilters: [isnotnull(graph" in s.read("g2")._jdf.queryExecution().toString()


@pytest.fixture
def claims_stream(spark, tmp_path):
    schema = "s string, p string, o string, source_iri string, confidence double"
    folder = tmp_path / "in"
    for i, row in enumerate([("a", "p", "x", "d1", 0.8), ("a", "p", "x", "d1", 0.5), ("a", "p", "x", "d2", 0.8)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stateful_noisy_or(spark, tmp_path, claims_stream):
    run = streams.noisy_or_stream(claims_stream).writeStream.outputMode("update").format("memory").queryName("noisy").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert max((r.n_sources, r.final_confidence) for r in spark.table("noisy").collect()) == (2, 0.96)


def test_stream_windows_equal_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run = streams.tumbling(live, late=None).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, streams.tumbling(events).collect()))


def test_incremental_compile_skips_unchanged(spark, tmp_path):
    schema = "fragment_key string, content_hash string"
    seen = []
    for batch in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.incremental(live, str(tmp_path / "frag"), str(tmp_path / "cp"), lambda df: seen.append(sorted(r.fragment_key for r in df.collect()))).start().awaitTermination()
    assert seen == [["a", "b"], ["b"]]


def test_store_swaps_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "q"))
    q = spark.createDataFrame([("g1", "a", "p", "x", "iri", 0.5), ("g2", "b", "p", "x", "iri", 0.5)], "graph string, s string, p string, o string, o_kind string, confidence double")
    s.load(q)
    before = s.read()
    s.replace(q.where("graph = 'g2'").withColumn("o", F.lit("y")))
    assert [r.o for r in s.read().collect()] == ["y"] and before.count() == 2  # who read before still can
    s.vacuum()
    assert s.count() == 1 and len(list((tmp_path / "q").glob("version=*"))) == 1
    s.replace(q.limit(0))
    assert s.count() == 0 and s.versions() == {}


def test_incremental_compiles_what_changed_since_the_last_time(spark, tmp_path):
    seen = []
    for n, h in enumerate(["h1", "h2", "h2", "h1"]):
        spark.createDataFrame([("k", h), ("same", "s")], "fragment_key string, content_hash string").coalesce(1).write.mode("append").json(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("fragment_key string, content_hash string").option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        streams.incremental(stream, str(tmp_path / "hashes"), str(tmp_path / "cp"), lambda d: seen.append(sorted(r.fragment_key for r in d.collect()))).start().awaitTermination()
    assert seen == [["k", "same"], ["k"], [], ["k"]]


def test_cache_alignment_and_pages(spark, tmp_path):
    c = "key string, body string, fetched_at timestamp"
    old = spark.createDataFrame([("a", "1", None), ("b", "1", None)], c).withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new = spark.createDataFrame([("a", "2", None)], c).withColumn("fetched_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    both = files.updated_cache(old, new)
    assert sorted((r.key, r.body) for r in both.collect()) == [("a", "2"), ("b", "1")]
    assert [r.key for r in files.pruned_cache(both, "2024-02-10 00:00:00", 20).collect()] == ["a"]
    a = spark.createDataFrame([("P1", "kc:b", "x"), ("P1", "kc:a", "x"), ("P2", "kc:c", None)], "pid string, predicate string, label string")
    (tmp_path / "a.yaml").write_text(files.alignment_text(a))
    assert sorted(map(tuple, files.read_alignment(spark, str(tmp_path / "a.yaml")).collect()), key=repr) == sorted(map(tuple, a.collect()), key=repr)
    files.write_pages(spark.createDataFrame([("s1", "# one"), ("s2", "# two")], "s string, page string"), str(tmp_path / "pages"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "pages")).collect() if r.value) == ["# one", "# two"]


def test_sql_functions(spark):
    from lodestone.plans import registry

    q = spark.createDataFrame([("trusted", "a", "rdfs:label", "Ada", "literal", 0.9), ("trusted", "a", "kc:knows", "b", "iri", 0.5), ("trusted", "a", "kc:knows", "c", "iri", 0.2)], "graph string, s string, p string, o string, o_kind string, confidence double")
    assert "kc_facts" in registry.register_sql(q)
    one = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert one("SELECT kc_local_name('http://x/y#z'), kc_route(0.5D), kc_noisy_or(array(0.5D, 0.5D)), kc_fuzzy_match('ada', 'Ada')") == [("z", "tentative", 0.75, 1.0)]
    assert sorted(one("SELECT * FROM kc_describe('b')")) == [("a", "kc:knows", "b")]
    assert one("SELECT * FROM kc_contradictions('kc:knows')") == [("a", ["b", "c"])] and one("SELECT s, distance FROM kc_suggest_sameas('Ida', 1)") == [("a", 1)]
    assert one("SELECT block FROM kc_rag_context('a')")[0][0].startswith("- knows: b\n- knows: c")
