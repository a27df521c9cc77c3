"""Suffix arrays by induced sorting, with numpy: one bucket at a time instead of one suffix.

``suffix_array`` classifies suffixes (S: smaller than the next, L: larger), sorts
the leftmost-S substrings by inducing from their first characters, names them, sorts
the string of names, and induces the whole array.  A bucket's entries are induced
together: those that stay in the bucket form the next wave, the rest go to their
buckets in order.  Waves are as many as the longest run of one character.

The string of names has about as many different characters as places, so its buckets hold
one entry each and induction would be a loop over entries; spelling names with digits
of few values was tried, but then every name is a leftmost-S substring again and no level
is shorter than the one above.  That one string is sorted by doubling ranks instead.

``common_prefixes`` gives the permuted array of longest common prefixes: for each place of
the text, how many characters its suffix shares with the one before it in order.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is."""
    n = len(t)
    rise = np.empty(n, bool)
    rise[-1] = True
    rise[:-1] = t[:-1] < t[1:]
    settled = np.append(t[:-1] != t[1:], True)
    where = np.where(settled, np.arange(n, dtype=np.int32), np.int32(n - 1))
    return rise[np.minimum.accumulate(where[::-1])[::-1]]


class Buckets:
    def __init__(self, t: np.ndarray):
        self.t, self.n = t, len(t)
        self.small = types(t)
        count = np.bincount(t)
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.lms = (np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1).astype(np.int32)

    def spread(self, sa: np.ndarray, at: np.ndarray, to: np.ndarray, step: int) -> None:
        """Put the entries, in order, into their buckets, next to what is there."""
        c = self.t[at]
        if len(at) < 64:
            for x, k in zip(at.tolist(), c.tolist(), strict=True):
                sa[to[k]] = x
                to[k] += step
            return
        order = np.argsort(c, kind="stable")  # a radix sort of 16 bits
        at, c = at[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(new, len(c)))
        chars = c[new]
        sa[np.repeat(to[chars] - step * new, count) + step * np.arange(len(c))] = at
        to[chars] += step * count

    def induce(self, sorted_lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost-S ones in theirs."""
        t, small = self.t, self.small
        sa = np.full(self.n, -1, np.int32)
        chars = np.flatnonzero(self.end > self.begin)
        own = t[sorted_lms]  # ascending
        cuts = np.searchsorted(own, np.arange(len(self.end) + 1))
        head = self.begin.copy()
        for c in chars.tolist():
            wave, done = sa[self.begin[c] : head[c]], []
            while len(wave):
                before = wave[wave > 0] - 1
                before = before[~small[before]]
                stay = t[before] == c
                done.append(before[~stay])
                wave = before[stay]
                sa[head[c] : head[c] + len(wave)] = wave
                head[c] += len(wave)
            s = sorted_lms[cuts[c] : cuts[c + 1]]
            done.append(s[s > 0] - 1)  # what stands before a leftmost S is an L, and greater
            out = np.concatenate(done) if len(done) > 1 else done[0]
            if len(out):
                self.spread(sa, out, head, 1)
        tail = self.end - 1
        sa[0] = self.n - 1  # the sentinel's suffix
        tail[0] = -1
        for c in chars[::-1].tolist():
            wave, done = sa[tail[c] + 1 : self.end[c]][::-1], []
            if c == 0:
                wave = sa[:1]
            while len(wave):
                before = wave[wave > 0] - 1
                before = before[small[before]]
                stay = t[before] == c
                done.append(before[~stay])
                wave = before[stay]
                sa[tail[c] - len(wave) + 1 : tail[c] + 1] = wave[::-1]
                tail[c] -= len(wave)
            if c:
                large = sa[self.begin[c] : head[c]][::-1]
                before = large[large > 0] - 1
                done.append(before[small[before]])
            out = np.concatenate(done) if len(done) > 1 else done[0] if done else sa[:0]
            if len(out):
                self.spread(sa, out, tail, -1)
        return sa


def named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the leftmost-S substrings, in the text's order, by their order; and which equal the one before in order."""
    # equal substrings have equal lengths and equal characters up to the next leftmost S
    length = np.zeros(len(t), np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, c = ordered[:-1], ordered[1:]
    same = length[a] == length[c]
    at, step = np.flatnonzero(same), 0
    while len(at):
        x, y = a[at] + step, c[at] + step
        differ = t[x] != t[y]
        same[at[differ]] = False
        step += 1
        at = at[~differ & (step < length[a[at]])]
    name = np.empty(len(t), np.int32)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], same


def doubled(t: np.ndarray, place: np.ndarray, enough: int) -> np.ndarray:
    """Suffix array by doubling; only suffixes that still tie are sorted again.

    ``place`` tells where each character begins in the text that t stands for; suffixes
    that tie over ``enough`` characters of it may stay in any order.
    """
    n = len(t)
    sa = np.argsort(t)
    new = np.concatenate([[True], t[sa][1:] != t[sa][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    reach = np.append(place, place[-1] + enough)
    k = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        suffix = sa[at]
        short = reach[np.minimum(suffix + k, n)] - place[suffix] < enough
        if not short.any():
            return sa
        wanted = np.zeros(n, bool)  # groups with a suffix that does not reach far enough yet
        wanted[rank[suffix[short]]] = True
        at = at[wanted[rank[suffix]]]
        suffix = sa[at]
        follow = suffix + k
        key = rank[suffix] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[at] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        new[at] = fresh
        k *= 2


def suffix_array(t: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Of characters below 65536 with a unique least one, 0, at the end.

    Suffixes that share ``enough`` characters (default: all) may stay in any order.
    """
    enough = enough or len(t)
    t = t.astype(np.uint16)
    b = Buckets(t)
    lms = b.lms
    if len(lms) < 2:
        return b.induce(lms)
    induced = b.induce(lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = induced[is_lms[induced]]
    names, same = named(t, lms, ordered)
    if same.any():
        ordered = lms[doubled(names, lms, enough)]
    return b.induce(ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, prefix: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Permuted: for each place, how many characters, ``most`` at the most, its suffix shares with the one before it in order.

    ``prefix`` are running polynomial hashes of t, ``inverse`` the powers that bring them to one
    origin; the length is found by halving, all places at once.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.flatnonzero(phi >= 0)
    j = phi[i]
    room = np.minimum(n - np.maximum(i, j), most)
    low = np.zeros(len(i), np.int64)
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        reach = low + step
        at = np.flatnonzero(reach <= room)
        x, y, k = i[at], j[at], reach[at]
        equal = (prefix[x + k] - prefix[x]) * inverse[x] == (prefix[y + k] - prefix[y]) * inverse[y]
        low[at[equal]] = reach[at[equal]]
        step >>= 1
    out = np.zeros(n, np.int64)
    out[i] = low
    return out
