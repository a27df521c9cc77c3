"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A transducer reads both token sequences at once.  Its state is the side that leads and
the bytes of its last token that the other side has not matched yet (the dangling
suffix); the next token of the side behind matches a part of them, all of them, or
more, and then leads.  Transitions are memoised by state and next token; a group
closes whenever nothing dangles, and each token read while something does
overlaps the token that leads: these are the links.

Both tokenizers cut a text before a single space between other characters (the first
splits there before it merges; the second has no piece with a space after another
character, which is checked), so a text is a sequence of units that begin with a
space, and the walk of a unit, from nothing dangling to nothing dangling, is kept
for a while: a unit is tokenized and walked once for many texts.

1. Each task takes about ``CHUNK`` bytes of texts as a block: its different units with their
   links, its texts as numbers of units, and in how many of its texts each
   different pair of linked ids is.  Blocks are written once.
2. Pairs are counted over all blocks, combined before the shuffle; the highest count of
   each id of the first vocabulary is as small as that vocabulary and is broadcast.
3. Counts go back to the blocks, one row for each different pair of a block, and each text
   sums up those of its links.

A null or empty text, and one whose tokens do not spell it (a tokenizer changed
characters), has no tokens: zeros and ''.  Each row counts as a document, repeated ones too.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.lineage import release, table
from .blobs import packed, unpacked
from .pack import _byte_characters
from .text import CACHES, carried_columns, chunks, trim

CHUNK = 2 << 20
CACHED_UNITS, KEPT_TRANSITIONS = 500_000, 500_000
MADE = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
BITS = 16  # of a token's id
# How the first tokenizer cuts texts before it merges (fixed value, of Latin-1 texts): contractions, letters, numbers, other characters, white space.
_L, _N, _W = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_pieces = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_near_space = re.compile(r"\s | \s")
_cut = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """Walks two sequences of tokens that spell the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides = a, b
        self.forget()

    def forget(self) -> None:
        self.dangling = {0: (1, b"")}  # state -> (who leads, what dangles); 0: nothing, as if b led, so a is read; else even: a leads
        self.numbers = {(1, b""): 0}
        self.memo: dict[int, int] = {}  # state << BITS | next token of the side behind -> state; -1: they do not agree

    def step(self, state: int, token: int) -> int:
        lead, rest = self.dangling[state]
        own = self.sides[1 - lead][token]
        after = None
        if own and own.startswith(rest):
            after = (1 - lead, own[len(rest) :])
        elif own and rest.startswith(own):
            after = (lead, rest[len(own) :])
        if after and not after[1]:
            after = (1, b"")
        if after and after not in self.numbers:
            number = 2 * len(self.numbers) + after[0]
            self.numbers[after] = number
            self.dangling[number] = after
        found = self.memo[state << BITS | token] = self.numbers[after] if after else -1
        return found

    def trace(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """(tokens of a and of b that are read at the end of each group, in turn; links as a << BITS | b); None if they do not spell the same."""
        known, step = self.memo.get, self.step
        ends, links = [], []
        i, j, n_a, n_b = 0, 0, len(a), len(b)
        while i < n_a:
            lead = a[i]
            i += 1
            state = known(lead)
            if state is None:
                state = step(0, lead)
            while state > 0:
                if state & 1:  # b leads
                    if i == n_a:
                        return None
                    token = a[i]
                    i += 1
                    links.append(token << BITS | lead)
                    after = known(state << BITS | token)
                    if after is None:
                        after = step(state, token)
                    if not after & 1:
                        lead = token
                else:
                    if j == n_b:
                        return None
                    token = b[j]
                    j += 1
                    links.append(lead << BITS | token)
                    after = known(state << BITS | token)
                    if after is None:
                        after = step(state, token)
                    if after & 1:
                        lead = token
                state = after
            if state < 0:
                return None
            ends += (i, j)
        return (ends, links) if j == n_b else None

    def walk(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of two sequences; None if they do not spell the same."""
        found = self.trace(a, b)
        if found is None:
            return None
        ends = [0, 0, *found[0]]
        groups = [(a[ends[k] : ends[k + 2]], b[ends[k + 1] : ends[k + 3]]) for k in range(0, len(ends) - 2, 2)]
        return groups, [(x >> BITS, x & ((1 << BITS) - 1)) for x in found[1]]


class Units(dict):
    """Unit (without the space before it) -> what is known of it, in bytes; ``most`` are kept.

    Four 32-bit numbers (tokens on both sides, groups, links), the links, the groups as text; nothing if its tokens do not spell it.
    """

    def __init__(self, a: str, b: str, most: int = CACHED_UNITS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.most = most
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.shown = _byte_characters()
        shown = {c: i for i, c in self.shown.items()}
        with open(a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        a_bytes = [b""] * (1 + max(vocabulary.values()))
        for piece, i in vocabulary.items():
            a_bytes[i] = bytes(map(shown.__getitem__, piece)) if all(c in shown for c in piece) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        usual = [not self.b.is_control(i) and not self.b.is_unknown(i) for i in range(len(pieces))]
        if any(u and "▁" in p.lstrip("▁") for p, u in zip(pieces, usual, strict=True)):
            raise ValueError("pieces go over spaces, so texts cannot be cut there")
        b_bytes = [(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) if usual[i] else b"" for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        if max(len(a_bytes), len(b_bytes)) > 1 << BITS:
            raise ValueError(f"ids do not fit {BITS} bits")
        self.names = list(map(str, range(max(len(a_bytes), len(b_bytes)))))

    def ids_of(self, units: list[str]) -> list[list[int]]:
        """Tokens of the first vocabulary. What its pattern does with Latin-1 is known, so these pieces go straight to its merges."""
        merge, other, out = self.a.model.tokenize, [], []
        for unit in units:
            if unit.isascii() or max(unit) <= "\xff":
                pieces = _pieces.findall(" " + unit)
                out.append([t.id for p in pieces for t in merge(p.encode().decode("latin-1").translate(self.shown))])
            else:
                other.append(len(out))
                out.append([])
        for k, e in zip(other, self.a.encode_batch_fast([" " + units[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def learn(self, units: list[str]) -> None:
        """Tokenize and walk units that are not known yet."""
        if len(self) + len(units) > self.most:
            self.clear()
        if len(self.transducer.memo) > KEPT_TRANSITIONS:
            self.transducer.forget()
        gc.disable()  # nothing here forms a cycle, and there are many small lists
        try:
            self._learn(units)
        finally:
            gc.enable()

    def _learn(self, units: list[str]) -> None:
        a_bytes, names, trace = self.transducer.sides[0].__getitem__, self.names.__getitem__, self.transducer.trace
        for i in range(0, len(units), 4096):
            part = units[i : i + 4096]
            for unit, a, b in zip(part, self.ids_of(part), self.b.encode(part, num_threads=1), strict=True):
                found = trace(a, b) if b"".join(map(a_bytes, a)) == b" " + unit.encode() else None
                if found:
                    ends, links = found
                    x, y, p, q, groups = list(map(names, a)), list(map(names, b)), 0, 0, []
                    for k in range(0, len(ends), 2):
                        i, j = ends[k], ends[k + 1]
                        groups.append(f"{x[p] if i == p + 1 else ','.join(x[p:i])}|{y[q] if j == q + 1 else ','.join(y[q:j])}")
                        p, q = i, j
                    found = array("I", [len(a), len(b), len(groups), len(links), *links]).tobytes() + ";".join(groups).encode()
                self[unit] = found or b""


@lru_cache(maxsize=1)
def _units(a: str, b: str) -> Units:
    return Units(a, b)


CACHES.append(_units.cache_clear)


def units_of(text: str) -> list[str]:
    """" " + text cut before each single space between other characters, each without its space."""
    return _cut.split(text) if text[:1] == " " or text[-1:] == " " or _near_space.search(text) else text.split(" ")


def expanded(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a ragged array: (which of ``rows``, place in the array) of all their items."""
    size = offsets[rows + 1] - offsets[rows]
    which = np.repeat(np.arange(len(rows)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + offsets[rows][which]


def blocks(documents: DataFrame, keep: tuple[str, ...], tokenizers: tuple[str, str], with_groups: bool) -> DataFrame:
    """block, docs (``keep`` and what is known without counts), texts and links (packed numbers), pair and seen; written once."""
    made = [*MADE, *["groups"] * with_groups]

    def run(batches):
        trim(_units.cache_clear)
        units = _units(*tokenizers)
        for chunk in chunks(batches, cap=CHUNK):
            cut = [units_of(t) if t else [] for t in (chunk.bytes_of(d).decode() for d in range(chunk.n))]
            distinct = list(dict.fromkeys(chain.from_iterable(cut)))
            missing = [u for u in distinct if u not in units]
            if len(units) + len(missing) > units.most:
                units.clear()
                missing = distinct
            units.learn(missing)
            known = [units[u] for u in distinct]
            number = {u: i if k else -1 for i, (u, k) in enumerate(zip(distinct, known, strict=True))}
            texts = [np.fromiter(map(number.__getitem__, c), np.int32, len(c)) for c in cut]
            texts = [t if not len(t) or t.min() >= 0 else t[:0] for t in texts]
            counts = np.frombuffer(b"".join([k[:16] or bytes(16) for k in known]), np.uint32).reshape(-1, 4).astype(np.int64)
            n_links = counts[:, 3]
            ends = (16 + 4 * n_links).tolist()
            link = np.frombuffer(b"".join([k[16:e] for k, e in zip(known, ends, strict=True)]), np.uint32)
            known = [k[e:] for k, e in zip(known, ends, strict=True)]
            groups = [b";".join([known[u] for u in t.tolist()]) for t in texts]
            size = np.array([len(t) for t in texts], np.int64)
            text = np.concatenate(texts)
            sums = lambda x: np.diff(np.append(0, np.cumsum(x[text]))[np.append(0, np.cumsum(size))])  # noqa: E731, B023
            pair, at = np.unique(link, return_inverse=True)
            of = np.unique(np.repeat(np.arange(chunk.n), size) * max(1, len(known)) + text)  # each unit of a text once
            which, place = expanded(np.append(0, np.cumsum(n_links)), of % max(1, len(known)))
            both = np.unique((of // max(1, len(known)))[which] * max(1, len(pair)) + at[place])
            seen = np.bincount(both % max(1, len(pair)), minlength=len(pair))
            own = [chunk.batch.column(chunk.batch.schema.get_field_index(c)) for c in keep]
            own += [pa.array(sums(c), pa.int64()) for c in counts.T]
            own += [pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()), *[pa.array([g.decode() for g in groups], pa.string())] * with_groups]
            docs = pa.ListArray.from_arrays(pa.array([0, chunk.n], pa.int32()), pa.StructArray.from_arrays(own, names=[*keep, *made]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), docs, pa.array([packed(size, text)], pa.binary()), pa.array([packed(n_links.astype(np.int32), at.astype(np.uint32))], pa.binary()), pa.array([pair.astype(np.int64)], pa.list_(pa.int64())), pa.array([seen], pa.list_(pa.int64()))],
                names=["block", "docs", "texts", "links", "pair", "seen"],
            )
        trim(_units.cache_clear)

    doc = T.StructType([documents.schema[c] for c in keep])
    for c in made:
        doc = doc.add(c, MADE.get(c, "string"))
    schema = T.StructType().add("block", "string").add("docs", T.ArrayType(doc)).add("texts", "binary").add("links", "binary").add("pair", T.ArrayType(T.LongType())).add("seen", T.ArrayType(T.LongType()))
    return table(documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema), "aligned")


def pair_counts(own: DataFrame) -> DataFrame:
    """pair (a << BITS | b), n (documents that link it), best (no pair with this a is in more)."""
    counted = own.select(F.explode(F.arrays_zip("pair", "seen")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.seen").alias("n"))
    counted = table(counted, "pairs")
    a = F.shiftright("pair", BITS).alias("a")
    most = counted.groupBy(a).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    return counted.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), tokenizers: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """The columns ``keep``, n_a, n_b, n_groups, n_links, groups_sha256 (with_groups: and groups), n_best, count_sum; these replace columns of their names.

    ``tokenizers``: paths of a byte-level BPE (tokenizers) and a model of pieces (sentencepiece), the same on all executors.
    """
    made = (*MADE, *["groups"] * with_groups, "n_best", "count_sum")
    keep = carried_columns(keep, made)
    own = blocks(documents, keep, tokenizers or default_tokenizers(), with_groups)
    told = own.select("block", F.explode("pair").alias("pair")).join(pair_counts(own), "pair")
    told = told.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("told"))
    told = table(told, "told")
    release(documents.sparkSession)
    both = own.select("block", "docs", "texts", "links").join(told, "block", "left").select("docs", "texts", "links", "told")

    def run(batches):
        trim()
        for batch in batches:
            for i in range(batch.num_rows):
                docs, texts, links, told = (c.slice(i, 1) for c in batch.columns)
                size, text = unpacked(texts[0].as_py())
                n_links, at = unpacked(links[0].as_py())
                answer = told.flatten()
                pair, n, best = (answer.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
                order = np.argsort(pair)  # as the block's own pairs
                offsets = np.append(0, np.cumsum(n_links, dtype=np.int64))
                bounds = np.append(0, np.cumsum(size))
                sums = []
                for x in (best[order].astype(np.int64), n[order]):
                    unit = np.diff(np.append(0, np.cumsum(x[at]))[offsets])
                    sums.append(pa.array(np.diff(np.append(0, np.cumsum(unit[text]))[bounds]), pa.int64()))
                rows = docs.flatten()
                yield pa.RecordBatch.from_arrays([*[rows.field(k) for k in range(rows.type.num_fields)], *sums], names=[*keep, *made])

    schema = T.StructType(list(own.schema["docs"].dataType.elementType)).add("n_best", "long").add("count_sum", "long")
    return both.mapInArrow(run, schema)


def walker(tokenizers: tuple[str, str] | None = None) -> Callable[[str], str | None]:
    """The groups of one text, for use beside Spark; None where its tokens do not spell it."""
    units = _units(*(tokenizers or default_tokenizers()))

    def groups(text: str) -> str | None:
        own = units_of(text)
        units.learn([u for u in own if u not in units])
        known = [units[u] for u in own]
        return b";".join(k[16 + 4 * int.from_bytes(k[12:16], "little") :] for k in known).decode() if all(known) else None

    return groups
