"""Token alignment against byte offsets of whole texts, and the transducer on vocabularies of its own."""

import random
from functools import lru_cache

import pytest

from lodestone.llm import align, queries
from lodestone.llm.pack import _byte_characters

from . import brute
from .test_contract import folder, sample

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@lru_cache
def sides():
    """Whole texts by both tokenizers, as (id, bytes)."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    byte = {c: i for i, c in _byte_characters().items()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def a(text):
        e = tokenizer.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in e.ids]

    def b(text):
        ids = model.encode(text)
        return [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in ids]

    return a, b


ODD = [
    " ", "  ", " a", "a ", "a  b", "\n", "a\n\n  b\t c", "x y z", "x   y", "▁", "a ▁ b", "a▁b", "<|endoftext|>", "one <|endoftext|> two<s> </s> <unk> <0x41>", "it's we're I'LL",
    "你好 世界", "\U0001f600 \U0001f469‍\U0001f680", "é é ﬁ", "　 x", "\x1c \x85 x", "\r\n a", "0123456789 12 3", "http://a.b/c?d=e&f=%20", "\x00 a", "a" * 300, "a \x1c b\x1c c", "​ ​", "tab\tend \t",
]


def test_equals_byte_offsets(spark, tmp_path):
    rows = [*sample()[:15], *[(100 + i, t, "en", "s", len(t)) for i, t in enumerate(ODD)]]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_token_alignment(spark, folder(spark, tmp_path, rows)).collect()}
    assert got == brute.op12([r[:2] for r in rows], *sides())
    assert got[0] == (0, 0, 0, 0, 0, 0, "") and sum(r[0] > 0 for r in got.values()) > 30


def test_equals_byte_offsets_on_test_data(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    assert got == brute.op12(docs, *sides())


def test_any_unicode(spark):
    r = random.Random(11)
    pool = [*map(chr, [*range(1, 0x250), 0x2581, 0x180E, 0x2028, 0x3000, 0x1680, 0x202F, 0xFEFF, 0x1F600, 0x10FFFF, 0x0378, 0xAC00, 0x1100, 0x0344])] + [" "] * 300
    docs = [(i, "".join(r.choices(pool, k=r.randint(1, 120)))) for i in range(400)]
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in align.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.op12(docs, *sides())


def test_latin_texts_are_cut_as_by_the_tokenizer():
    r = random.Random(12)
    units = align.Units(*align.default_tokenizers())
    texts = ["".join(r.choices([*map(chr, range(1, 256)), *"     \n'stdmlreve" * 8], k=r.randint(1, 60))) for _ in range(3000)]
    assert units.ids_of(texts) == [e.ids for e in units.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_transducer(seed):
    r = random.Random(seed)
    vocabulary = [[bytes(r.choices(b"ab", k=r.randint(1, 4))) for _ in range(12)] + [b"a", b"b"] for _ in range(2)]
    walker = align.Transducer(*vocabulary)
    for _ in range(300):
        text = bytes(r.choices(b"ab", k=r.randint(0, 12)))
        cut = []
        for side in vocabulary:
            at, ids = 0, []
            while at < len(text):
                i = r.choice([i for i, t in enumerate(side) if text.startswith(t, at)])
                ids.append(i)
                at += len(side[i])
            cut.append(ids)
        groups, links = walker.walk(*cut)
        assert [[i for g in groups for i in g[k]] for k in (0, 1)] == cut
        spelled = [[b"".join(vocabulary[k][i] for i in g[k]) for g in groups] for k in (0, 1)]
        assert spelled[0] == spelled[1]
        spans = [[(i, sum(len(vocabulary[k][x]) for x in ids[:n]), sum(len(vocabulary[k][x]) for x in ids[: n + 1])) for n, i in enumerate(ids)] for k, ids in enumerate(cut)]
        assert sorted(links) == sorted((i, j) for i, a, b in spans[0] for j, c, d in spans[1] if a < d and c < b)
        assert len(groups) == len({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        if cut[1]:
            assert walker.walk(cut[0], cut[1][:-1]) is None and walker.walk(cut[0], [*cut[1], 12]) is None


def test_general_form(spark):
    docs = spark.createDataFrame([("x", "one two", 1), (None, None, 2), ("x", "one two", 3)], "key string, text string, n_best int")
    got = align.align(docs, keep=("key", "n_best"), with_groups=True).collect()
    assert {r.key for r in got} == {"x", None} and [r.groups for r in got if r.key is None] == [""]
    one = [r for r in got if r.key == "x"]
    assert len(one) == 2 and one[0] == one[1] and one[0].groups == align.walker()("one two") and one[0].n_best == one[0].n_links and one[0].count_sum == 2 * one[0].n_links


def test_texts_beyond_a_chunk_and_a_full_cache(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 5000)
    text = " ".join(map(str, range(9000)))
    rows = [(1, "a b"), (2, text), (3, text), (4, "")]
    got = {r.doc_id: r for r in align.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want = brute.op12(rows, *sides())
    assert {d: tuple(r[c] for c in COLUMNS) for d, r in got.items()} == want


def test_units_are_forgotten():
    small = align.Units(*align.default_tokenizers(), most=3)
    for part in (["a", "b"], ["c", "d"], ["e"]):
        small.learn(part)
    assert set(small) == {"c", "d", "e"}
