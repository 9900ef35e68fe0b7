"""Similarity of strings by their longest common subsequence, on the scale 0 to 100.

ratio = 100 * 2 * LCS / (|a| + |b|), which no built-in function gives; it runs as an Arrow UDF over candidates that built-in
expressions have thinned out.  The LCS is computed bit-parallel: one integer operation for each code point of one string.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points after which :func:`close` looks whether the ratio can still be reached.
STRIDE = 16


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # a zero bit is a matched position
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    """The ratio of the sorted words."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 where the words of one contain those of the other; else the best of the pairs of common, and common with own, words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, (common, " ".join(sorted(s))))) for s in (x - y, y - x))
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


def _pairwise(score):
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def columns():
    """The three scores as functions of two columns; made on demand, as they need a session."""
    return {f.__name__: _pairwise(f) for f in (ratio, token_sort_ratio, token_set_ratio)}


def close(a: str, b: str, percent: int) -> bool:
    """ratio >= percent, decided in whole numbers; what of ``b`` has no match so far ends it once that is too much."""
    total = len(a) + len(b)
    least = -(-percent * total // 200)
    if least > min(len(a), len(b)):
        return False
    if not least:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for at in range(0, len(b), STRIDE):
        for c in b[at : at + STRIDE]:
            hit = free & where.get(c, 0)
            free = (free + hit | free - hit) & full
        matched = len(a) - free.bit_count()
        if matched + max(0, len(b) - at - STRIDE) < least:
            return False
    return True
