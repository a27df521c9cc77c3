"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The patterns give the base spans.  The method adds strings that stand in a
sensitive context (``bearer``, ``private key``, ``credential`` ... shortly
before them) and that the text around them does not explain: a zstandard
compressor is primed with a dictionary of identifiers and the surrounding
text, and the marginal compressed bytes of the candidate are what it adds to
the compressed size of the context alone.  Candidates that cost at least
``novelty`` bytes a character are incompressible there and are reported.

A candidate runs to its true end, dots inside it included, and is measured in pieces
short enough that their literals are not entropy-coded; one incompressible piece is
enough to report it whole.  The search goes on from what was reported to the candidates
that adjoin it (nothing but punctuation and white space between), and over the whole
body of a PEM private key, so its other lines are found although no sensitive word
stands near them.  The short last line of such a block is taken too.
Whatever its letters or digits are, a candidate is measured; only those made of dictionary
words alone (with up to four digits) are not.  Copies of a candidate, cut or with other text attached, do not explain it.

Whole texts are searched; offsets count code points, ends are exclusive.  A null
or empty text has no spans.  Repeated rows are each scanned.  No row moves.

Spans of different kinds may overlap: all are listed, and what any of them covers is masked once.
A candidate that lies inside base spans is not listed again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from .text import carried_columns, chunks
from .words import WORDS

# The base patterns, by kind, in the order in which ties are written.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the same as all runs with the short ones dropped
#: Lower-case parts of which any match has one: texts without them skip the slower patterns.
ASSIGN_STEMS = ("pass", "secret", "token", "api")
SENSITIVE_STEMS = ("bearer", "authoriz", "credential", "key", "secret", "pass", "token", "client", "session", "cookie", "signature")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?i:bearer|authorization|credential|private[ _-]?key|access[ _-]?key|secret|passphrase|passwd|password|token|api[ _-]?key|client[ _-]?id|session[ _-]?id|cookie|signature)", re.ASCII)
CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_=.-]{16})[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*")  # a maximal run without dots around it
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SHORTEST = 16
PIECE = 48  # zstandard writes fewer than 64 literals as they are, so that a cost does not depend on the alphabet
#: What may stand between the lines or pieces of one secret, and a last line that is shorter than a candidate.
ADJOINS = re.compile(r"\W*")
TAIL = re.compile(r"[^\S\r\n]*\r?\n[^\S\r\n]*([A-Za-z0-9+/_=.]+)[^\S\r\n]*(?=[\r\n]|\Z)")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----")
PEM_END = "-----END"
#: Identifiers of configuration and source code: text that is no secret however odd it looks.
IDENTIFIERS = b" ".join(
    b"access_key_id secret_access_key authorization bearer client_id client_secret session_id private_key public_key passphrase password username api_key api_token endpoint hostname localhost connection_string database_url "
    b"environment variable example placeholder your_token_here changeme true false null none undefined function return import export const static public private class string integer boolean http https www com org net json yaml xml "
    b"-----BEGIN RSA PRIVATE KEY----- -----END RSA PRIVATE KEY----- 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
)


SEPARATED = re.compile("[_=/+.-]+")


def worded(candidate: str) -> bool:
    """Nothing but dictionary words, and up to four digits beside them."""
    pieces = [p for p in SEPARATED.split(candidate) if p]
    numbers = [p for p in pieces if p.isdigit()]
    words = all(p.lower() in WORDS and p[1:] in (p[1:].lower(), p[1:].upper()) for p in pieces if not p.isdigit())
    return words and (len(numbers) < len(pieces) or not pieces) and sum(map(len, numbers)) <= 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches."""
    low = text.lower()
    out = []
    if any(x in low for x in ASSIGN_STEMS):
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed size of a candidate, given its surroundings and the identifiers."""

    def __init__(self, identifiers: bytes = IDENTIFIERS, around: int = 200, reach: int = 40, novelty: float = 0.6):
        self.identifiers, self.around, self.reach, self.novelty = identifiers, around, reach, novelty

    def cost(self, before: str, candidate: str, after: str) -> float:
        """Bytes a character that the candidate adds to what stands around it."""
        context = f"{before}\n{after}".encode()
        known = zstandard.ZstdCompressionDict(self.identifiers + b"\n" + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda x: len(zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False).compress(x))
        return (size(before.encode() + candidate.encode()) - size(before.encode())) / len(candidate)

    def novel(self, text: str, a: int, b: int) -> bool:
        """Whether text[a:b] has a piece that costs ``novelty``: of the whole in even cuts, or between its dots."""
        word = text[a:b]
        far = self.around + 4 * SHORTEST  # a copy at the edge is seen with enough of it to be known
        before, after = without_copies(word, text[max(0, a - far) : a])[-self.around :], without_copies(word, text[b : b + far])[: self.around]
        cuts = [(len(word) * i // n, len(word) * (i + 1) // n) for n in [-(-len(word) // PIECE)] for i in range(n)]
        cuts += [m.span() for m in re.finditer(rf"[^.]{{{SHORTEST},{PIECE}}}", word) if m[0] != word]
        seen: set[str] = set()
        for i, j in cuts:
            piece = word[i:j]
            if piece in seen:
                continue
            seen.add(piece)
            if self.cost((before + word[max(0, i - self.around) : i])[-self.around :], piece, after) >= self.novelty:
                return True
        return False

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        low = text.lower()
        if not any(x in low for x in SENSITIVE_STEMS):
            return
        blocks = {m.end(): m.start() for m in PEM.finditer(text)} if "PRIVATE KEY" in text else {}
        starts = sorted(blocks)
        tops = [blocks[e] for e in starts]
        bases = merged(base)
        taken = 0
        for s in SENSITIVE.finditer(text):
            k = bisect_right(tops, s.start()) - 1
            at, limit = s.end(), s.end() + self.reach
            if k >= 0 and s.end() <= starts[k]:  # the first line of a private key: all of its body is meant
                end = text.find(PEM_END, starts[k])
                at, limit = starts[k], end - 1 if end >= 0 else starts[k] + self.reach
            at = max(at, taken)
            while at <= limit and (m := CANDIDATE.search(text, at, len(text))):
                a, b = m.span()
                if a > limit:
                    break
                at = taken = b
                if b - a < SHORTEST:  # the rest was dots
                    continue
                if not covered(bases, a, b):
                    if worded(m[0]) or not self.novel(text, a, b):
                        continue
                    yield a, 3, b
                # The next line or piece is as near as the first: on to it.
                if (tail := TAIL.match(text, b)) and len(tail[1]) < SHORTEST and alone(text, a) and not worded(tail[1]):
                    if not covered(bases, *tail.span(1)):
                        yield tail.start(1), 3, tail.end(1)
                    at = taken = tail.end()
                limit = max(limit, ADJOINS.match(text, at).end())


def without_copies(word: str, context: str) -> str:
    """The context less the runs that have SHORTEST characters in a row in common with the word."""
    found = [m for m in RUN.finditer(context)]
    if not found:
        return context
    grams = {word[i : i + SHORTEST] for i in range(len(word) - SHORTEST + 1)}
    for m in reversed(found):
        if any(m[0][i : i + SHORTEST] in grams for i in range(len(m[0]) - SHORTEST + 1)):
            context = f"{context[: m.start()]} {context[m.end() :]}"
    return context


def alone(text: str, a: int) -> bool:
    """Whether only white space stands before a on its line."""
    return not text[max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1 : a].strip()


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def covered(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a:b lies in one of the merged spans."""
    k = bisect_right(spans, (a, 1 << 62)) - 1
    return k >= 0 and b <= spans[k][1]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), finder: Novelty | None = None, redact: bool = False) -> DataFrame:
    """The columns ``keep`` (with ``redact``, their text has "[secret]" in place of each span), n_assign, n_access, n_hex, n_novel, base_spans, spans; these replace columns of their names."""
    finder = finder or Novelty()
    keep = carried_columns(keep, ("n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"))

    def run(batches):
        for chunk in chunks(batches):  # a worker holds the strings of one, not of a batch
            batch = chunk.batch
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            rows, out = [], []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                spans = sorted([*base, *finder.spans(text, base)])
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*n, written(base), written(spans)))
                if redact:
                    out.append(masked(text, spans))
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if redact:
                own = [pa.array([o if t is not None else None for o, t in zip(out, texts, strict=True)], pa.string()) if c == "text" else x for c, x in zip(keep, own, strict=True)]
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *found], names=[*keep, "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"])

    schema = T.StructType([documents.schema[c] for c in keep])
    for c in ("n_assign", "n_access", "n_hex", "n_novel"):
        schema = schema.add(c, "long")
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema.add("base_spans", "string").add("spans", "string"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
