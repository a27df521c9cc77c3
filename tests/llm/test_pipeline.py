"""Each stage against a brute-force version on its own input, and the whole run."""

from pathlib import Path

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from lodestone.llm import langid, pack, text
from lodestone.plans.lineage import shared_dir

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """name -> (rows in, rows out)"""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as n_words", "'x' as items"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        docs = after
    return out


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_language(stages):
    before, after = stages["language_id"]
    assert after and {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    want = brute.op4([(r.doc_id, r.text, r.lang) for r in before])
    old = {r.doc_id: r.lang for r in before}
    assert all(r.lang == (old[r.doc_id] or want[r.doc_id][1]) for r in after)


def test_noise_has_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(-1, "xq7 zzkw qqj vvxk zqxj kkwq zxqv", None, "s", 5), (-2, "日本語のテキストです", None, "s", 5), (-3, docs.where("lang = 'de'").first().text, None, "s", 5), (None, docs.where("lang = 'fr'").first().text, None, "s", 5), (-5, None, "en", "s", 0)]
    rows = spark.createDataFrame(more, docs.schema).unionByName(docs)
    out = cp.language_id(spark, rows, sf_dir)
    assert {(r.doc_id, r.lang) for r in out.where("doc_id < 0 OR doc_id IS NULL").collect()} == {(-3, "de"), (None, "fr")}


def test_hard_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and empty texts, one longer than a chunk."""
    r = __import__("random").Random(3)
    text = lambda n: " ".join("".join(r.choices("etaoinshrdl", k=r.randint(2, 8))) for _ in range(n))
    rows = [(i, text(60), "en", "s", 1) for i in range(20)] + [(None, text(50), None, None, None), (None, None, None, None, None), (3, text(40), "en", "s", 1), (21, "", "en", "s", 1), (22, text(230_000), "en", "s", 1)]
    rows += [(23, rows[0][1], "en", "s", 1), (24, rows[1][1] + " password=hunter22", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.table(stage(spark, docs, str(tmp_path)), name)
        kept[name] = sorted((x.doc_id if x.doc_id is not None else -1) for x in docs.select("doc_id").collect())
    every = [-1, *range(21)]
    assert kept["language_id"] == sorted([-1, *range(20), 3, 22, 23, 24])
    assert kept["near_dedup"] == sorted([-1, *range(20), 22]) and kept["decontaminate"] == [x for x in sorted([-1, *range(20), 22]) if x != 5] == kept["secrets"]
    assert every and sum(x.length for x in cp.packing(spark, docs, str(tmp_path)).collect()) > 230_000


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    five = {}
    for d, t in pairs(before):
        w = brute.words(t, True)
        five[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(five)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(five[a] & five[b])
            if n and 100 * n >= 80 * (len(five[a]) + len(five[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in after) == sorted(d for d in ids if find(d) == d)


def test_benchmark_passages_go(spark, stages, sf_dir):
    before, after = stages["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.op8(pairs(before), items)
    assert {r.doc_id for r in after} == {d for d, x in want.items() if not x[-1]} != {r.doc_id for r in before}


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    text = dict(pairs(after))
    found = brute.op10(pairs(before))
    assert set(text) == set(found)
    for d, old in pairs(before):
        assert (text[d] == old) == (sum(found[d][:3]) == 0)
    assert all(sum(x[:3]) == 0 for x in brute.op10(pairs(after)).values())
    assert all(r.n_chars == len(r.text) for r in after)


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    brute.op9(pairs(before), [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in after], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_run_gives_the_same_pieces(spark, sf_dir, stages):
    key = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(cp.run(spark, sf_dir).collect()) == key(stages["packing"][1])


def test_stages_leave_no_work_behind(spark, sf_dir):
    """The shared folder gets what packing reads, and nothing of the stages before."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    names = lambda: {p.name for p in folder.iterdir() if (p / "_SUCCESS").exists()}
    before = names()
    rows = cp.run(spark, sf_dir).count()
    assert rows and sorted(n.rsplit("-", 1)[0] for n in names() - before) == ["pack", "secrets"]


def test_workers_let_go_of_other_stages(spark):
    """A stage's task clears what others have cached, keeps its own, and holds the strings of few texts."""
    words = pack._words(pack.default_tokenizer(), 1000)
    text.trim(pack._words.cache_clear)
    assert pack._words(pack.default_tokenizer(), 1000) is words
    batch = pa.RecordBatch.from_pydict({"text": ["one two", None] * 500})
    parts = list(langid.slices(iter([batch]), "text"))
    assert pack._words.cache_info().currsize == 0
    assert sum((t for _, t in parts), []) == batch.column(0).to_pylist() and max(len(t) for _, t in parts) <= 256
    assert all(p.column(0).to_pylist() == t for p, t in parts)


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
