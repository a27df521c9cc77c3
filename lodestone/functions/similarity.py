"""Fuzzy scores of strings as pandas UDFs on difflib; they differ from those of other libraries."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def ratio_of(a: str | None, b: str | None) -> float:
    return round(SequenceMatcher(None, a or "", b or "", autojunk=False).ratio(), 6)


def similar(a: str, b: str, least: float) -> bool:
    """Whether the ratio reaches ``least``; bounds by length and by letters come first."""
    if a == b:
        return True
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def partial_of(a: str | None, b: str | None) -> float:
    """Best ratio of the shorter string with as long a part of the longer one, from 0 to 100."""
    a, b = sorted((a or "", b or ""), key=len)
    if not a:
        return 0.0
    if a in b:
        return 100.0
    best = 0.0
    for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, a, b[start : start + len(a)], autojunk=False).ratio())
    return round(100 * best, 4)


def token_sort_of(a: str | None, b: str | None) -> float:
    sort = lambda x: " ".join(sorted((x or "").lower().split()))
    return round(100 * SequenceMatcher(None, sort(a), sort(b), autojunk=False).ratio(), 4)


def weighted_of(a: str | None, b: str | None) -> float:
    """The best of plain, token-sorted and (discounted) partial scores."""
    return max(100 * ratio_of((a or "").lower(), (b or "").lower()), 0.95 * token_sort_of(a, b), 0.9 * partial_of((a or "").lower(), (b or "").lower()))


def _scored(f, a, b):
    """f over two columns in Arrow batches; built when it is used, as it needs a session."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def ratio(a, b):
    return _scored(ratio_of, a, b)


def partial_ratio(a, b):
    return _scored(partial_of, a, b)


def token_sort_ratio(a, b):
    return _scored(token_sort_of, a, b)


def weighted_ratio(a, b):
    return _scored(weighted_of, a, b)
