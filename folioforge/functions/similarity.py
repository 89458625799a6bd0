"""String similarities: built-ins where Spark has them, Arrow UDFs for the rest."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half the number of misplaced matches, not rounded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, of_a = list(b), []
    taken = [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == c:
                taken[j] = True
                of_a.append(c)
                break
    m = len(of_a)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(of_a, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for a common prefix of up to four characters where it is 0.7 or more."""
    base = jaro(a, b)
    if base < 0.7:
        return base
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return base + 0.1 * prefix * (1 - base)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def jaro_winkler_block(asked: str, texts: list[str]) -> np.ndarray:
    """jaro_winkler(asked, text) of each text, worked side by side for texts of one length."""
    out = np.zeros(len(texts))
    a, size = _codes(asked), np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(size):
        rows = np.nonzero(size == n)[0]
        if not n or not len(a):
            out[rows] = float(n == len(a))
            continue
        b = np.stack([_codes(texts[i]) for i in rows])
        reach = max(max(len(a), n) // 2 - 1, 0)
        taken, hits = np.zeros(b.shape, bool), np.zeros((len(rows), len(a)), bool)
        for i, c in enumerate(a):
            lo, hi = max(0, i - reach), min(n, i + reach + 1)
            if lo >= hi:
                continue
            free = (b[:, lo:hi] == c) & ~taken[:, lo:hi]
            hits[:, i] = free.any(axis=1)
            found = np.nonzero(hits[:, i])[0]
            taken[found, lo + free[found].argmax(axis=1)] = True
        m = hits.sum(axis=1)
        wrong = np.broadcast_to(a, hits.shape)[hits] != b[taken]
        moved = np.bincount(np.nonzero(hits)[0], weights=wrong, minlength=len(rows)) / 2
        base = np.where(m > 0, (m / len(a) + m / n + (m - moved) / np.maximum(m, 1)) / 3, 0.0)
        k = min(4, len(a), n)
        prefix = np.logical_and.accumulate(b[:, :k] == a[:k], axis=1).sum(axis=1)
        out[rows] = np.where(base < 0.7, base, base + 0.1 * prefix * (1 - base))
        out[rows[(b == a).all(axis=1)] if n == len(a) else []] = 1.0
    return out


def _pairs(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def jaro_col(a: Column, b: Column) -> Column:
    return _pairs(jaro)(a, b)


def jaro_winkler_col(a: Column, b: Column) -> Column:
    return _pairs(jaro_winkler)(a, b)


def ratio_col(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio."""
    return _pairs(lambda x, y: SequenceMatcher(None, x, y).ratio())(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one contains the other, else the words' Jaccard."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda c: F.split(c, r"\s+")
    return F.when(a.isNull() | b.isNull(), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(jaccard(words(x), words(y)))
