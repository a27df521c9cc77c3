"""Plain-Python versions of the contract queries, one document or pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


def op2(docs):
    sets = {}
    for d, text in docs:
        w = words(text, True)
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    by = defaultdict(list)
    for d, s in sets.items():
        by[s].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for s, ds in by.items():
        if s:
            for d in ds[1:]:
                join(ds[0], d)
    inverted = defaultdict(list)
    distinct = [(ds[0], s) for s, ds in by.items() if s]
    common = Counter()
    for d, s in distinct:
        for x in s:
            for e in inverted[x]:
                common[e, d] += 1
            inverted[x].append(d)
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            join(a, b)
    least = {}
    for d in sets:
        least[find(d)] = min(d, least.get(find(d), d))
    return {d: (len(sets[d]), least[find(d)], least[find(d)] == d) for d in sets}


def op3(docs, k=400):
    starts = Counter()
    data = {d: (t or "").encode() for d, t in docs}
    for b in data.values():
        for i in range(len(b) - k + 1):
            starts[b[i : i + k]] += 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if starts[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def op5(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        rep = {i + j for p in seen.values() if len(p) > 1 for i in p for j in range(8)}
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
    return out


def op6(docs, k=13):
    least = {}
    tokens = {d: words(t) for d, t in docs}
    for d, w in tokens.items():
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            least[x] = min(d, least.get(x, d))
    out = {}
    for d, w in tokens.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def op8(docs, items, k=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = defaultdict(set)
    sizes = set()
    for item, t in items:
        w = word.findall((t or "").encode().lower())
        n = min(k, len(w))
        sizes.add(n)
        for i in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[i : i + n])].add(str(item))
    out = {}
    for d, t in docs:
        w = word.findall((t or "").encode().lower())
        hit, found = set(), set()
        for n in sizes - {0}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def op9(docs, rows, tokenizer, length=4096):
    """Checks the pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); ids must be unique."""
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for d, start, n, crc, total, sequence, offset in rows:
        pieces[d].append((start, n, crc, total))
        sequences[sequence].append((offset, n))
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for start, n, crc, total in sorted(pieces.pop(d)):
            assert start == at and total == len(ids) and n > 0
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))
            at += n
        assert at == len(ids)
    assert not pieces
    short = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
        short += at < length
    assert short <= 1


def op10(docs):
    kinds = (
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    out = {}
    for d, t in docs:
        n, spans = [], []
        for k, (name, pattern, good) in enumerate(kinds):
            own = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(t or "") if good(m)]
            n.append(len(own))
            spans += own
        out[d] = (*n, sha(",".join(x for _, _, x in sorted(spans))))
    return out


def op7(docs, rounds=200):
    """Base score, and the score with weights from exact expectation-maximisation."""
    from math import log2, log10

    tokens = {d: [*words(t, True), None] for d, t in docs}
    out_of = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    one, two = Counter(), Counter()
    for d, w in tokens.items():
        if not out_of[d]:
            one.update(w)
            two.update(zip([b"<s>", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context[b"<s>"] = sum(not x for x in out_of.values())
    bucket = lambda c: int(log2(c)) + 1 if c else 0
    weight = {b: [0.4, 0.5, 0.1] for b in range(65)}
    weight[0] = [0, 0.8, 0.2]
    cases = Counter()
    for (a, b), c in two.items():
        cases[c, context[a], one[b]] += c
    by = defaultdict(list)
    for (c2, cv, cw), k in cases.items():
        by[bucket(cv - 1)].append(((c2 - 1) / max(1, cv - 1) if c2 > 1 else 0, (cw - 1) / (n - 1), 1 / (v + 1), k))
    for b, own in by.items():
        for _ in range(rounds):
            total = [1e-3 * (b > 0), 1e-3, 1e-3]
            for *p, k in own:
                s = [x * y for x, y in zip(weight[b], p, strict=True)]
                total = [t + k * x / sum(s) for t, x in zip(total, s, strict=True)]
            weight[b] = [t / sum(total) for t in total]
    out = {}
    for d, w in tokens.items():
        base = sum(log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0
        for a, x in zip([b"<s>", *w], w, strict=False):
            l2, l1, l0 = weight[bucket(context[a])]
            score += log10((l2 * two[a, x] / context[a] if context[a] else 0) + l1 * one[x] / n + l0 / (v + 1))
        out[d] = (out_of[d], len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


def op1(texts, templates, coverage=0.8, slack=1.25):
    """(name, first word, end word, aligned) by text, for notices and headers: every window is aligned."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def patience(a, b):
        """Aligned pairs of a and b: equal ends, then unique common words in the longest ascending order, and so on between them."""
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(0, 0), *((i + 1, j + 1) for i, j in patience(a[1:], b[1:]))]
        if a[-1] == b[-1]:
            return [*patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
        unique = [(a.index(w), b.index(w)) for w in dict.fromkeys(a) if a.count(w) == 1 == b.count(w)]
        chains = []  # the longest ascending one; of equal ones as a patience game finds it
        for i, j in sorted(unique):
            k = sum(chain[-1][1] < j for chain in chains)
            chains[k : k + 1] = [[*(chains[k - 1] if k else []), (i, j)]]
        if not chains:
            return []
        out, ends = [], [(-1, -1), *chains[-1], (len(a), len(b))]
        for (i, j), (k, m) in zip(ends, ends[1:]):
            out += [(i + 1 + x, j + 1 + y) for x, y in patience(a[i + 1 : k], b[j + 1 : m])]
            out += [(k, m)] if k < len(a) else []
        return out

    result = []
    for text in texts:
        own = word.findall((text or "").encode().lower())
        found = []
        for name, t in templates.items():
            t = word.findall(t.encode().lower())
            done = 0
            for s in range(len(own)):
                if s < done:
                    continue
                pairs = patience(own[s : s + int(slack * len(t)) + 2], t)
                if 100 * len(pairs) >= 100 * coverage * len(t) and pairs[0][0] == 0:
                    found.append((name, s, s + pairs[-1][0] + 1, len(pairs), len(t)))
                    done = s + pairs[-1][0] + 1
        result.append(found)
    return result


def op4(docs, buckets=1 << 16):
    """doc_id -> (held out, language, score) of (doc_id, text, lang), with plain counts."""
    mask = (1 << 64) - 1

    def grams(text):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")) + " "
        s = re.sub(" +", " ", s) if s.strip() else "  "
        for i in range(len(s) - 1):
            h = 0
            for n in (1, 2, 3):
                if i + n <= len(s):
                    h = (h * 0x9E3779B97F4A7C15 + ord(s[i + n - 1]) + n) & mask
                    if n > 1 or s[i] != " ":
                        x = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
                        yield (x >> 40) % buckets

    out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in docs}
    counts, texts = defaultdict(Counter), Counter()
    for d, text, lang in docs:
        if not out[d] and text is not None and lang is not None:
            counts[lang].update(grams(text))
            texts[lang] += 1
    total = {x: sum(c.values()) + 0.5 * buckets for x, c in counts.items()}
    result = {}
    for d, text, _ in docs:
        if not any(c.isalpha() for c in text or "") or not counts:
            result[d] = out[d], "und", 0.0
            continue
        log = {x: math.log(texts[x] / sum(texts.values())) + sum(math.log((counts[x][b] + 0.5) / total[x]) for b in grams(text)) for x in sorted(counts)}
        best = max(sorted(log), key=lambda x: log[x])
        result[d] = out[d], best, 1 / sum(math.exp(v - log[best]) for v in log.values())
    return result


def planted_runs(docs):
    for d, text in docs:
        w = words(text)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield d, w


def runs_of(w, least=12):
    """All (start, length, period), period by period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if (n := i + q - s) >= max(least, 2 * q):
                found.setdefault((s, n), q)  # the smallest period of this stretch
    return sorted((s, n, q) for (s, n), q in found.items())


def op11(docs):
    out = {}
    for d, w in planted_runs(docs):
        runs = sorted(runs_of(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        out[d] = (len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op13(docs, least_docs=3):
    lines = [(d, (text or "").split("\n")) for d, text in docs]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(list)
    for d, own in lines:
        for k in {key(x) for x in own}:
            if len(k) >= 20:
                held[k].append(d)
    out = {}
    for d, own in lines:
        kept = [x for x in own if len(held.get(key(x), ())) < least_docs or d == max(held[key(x)], key=lambda i: (i is not None, i))]
        out[d] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    return out


def op12(docs, a, b):
    """By byte offsets of whole texts: ``a`` and ``b`` give a text's tokens as (id, bytes)."""
    tokens, held = {}, Counter()
    for d, text in docs:
        x, y = (a(text), b(text)) if text else ([], [])
        if text and not b"".join(t for _, t in x) == b"".join(t for _, t in y) == b" " + text.encode():
            x = y = []
        spans = [[(i, sum(len(t) for _, t in side[:k]), sum(len(t) for _, t in side[: k + 1])) for k, (i, _) in enumerate(side)] for side in (x, y)] if len(x) < 600 else None
        if spans is None:
            ends = [[0], [0]]
            for e, side in zip(ends, (x, y), strict=True):
                for _, t in side:
                    e.append(e[-1] + len(t))
            spans = [[(i, e[k], e[k + 1]) for k, (i, _) in enumerate(side)] for e, side in zip(ends, (x, y), strict=True)]
        links, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        at = [0, 0]
        for high in both:
            part = []
            for side in (0, 1):
                k = at[side]
                while k < len(spans[side]) and spans[side][k][2] <= high:
                    k += 1
                part.append(",".join(str(i) for i, *_ in spans[side][at[side] : k]))
                at[side] = k
            groups.append("|".join(part))
            low = high
        tokens[d] = (len(x), len(y), groups, links)
        held.update(set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return {
        d: (n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha(";".join(groups)) if groups else "") for d, (n_a, n_b, groups, links) in tokens.items()
    }
