"""Clear-text similarities of two string columns.  All but Jaro-Winkler are built-in expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .qgram import qgrams, unique_qgrams

SIZES = {"bigrams": 2, "trigrams": 3, "quadgrams": 4}
METHODS = ("jaro_winkler", "exact", *(f"{m}_{s}" for m in ("jaccard", "cosine", "dice") for s in SIZES))
THRESHOLD = 0.70
#: Letters up to which strings are compared many pairs at a time; longer ones go pair by pair.
LETTERS = 64


def jaro(a: str, b: str) -> float:
    """Matches within half the longer length, less one; half the transposed ones, rounded down, count against."""
    if a == b:
        return 1.0 if a else 0.0
    if len(a) > len(b):
        a, b = b, a
    reach = max(len(b) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j, u in enumerate(used) if u]
    m, t = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Above 0.7, a common beginning of any length adds weight min(0.1, 1 / longer length) a letter."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        prefix += 1
    return j + min(0.1, 1 / max(len(a), len(b))) * prefix * (1 - j)


def _letters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (letters by strings, zeros behind the last) and lengths."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    out = np.zeros((len(values), sizes.max(initial=0)), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out.T, sizes


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of each pair, letter by letter over all pairs."""
    (x, n), (y, k) = _letters(a), _letters(b)
    top = max(len(x), len(y))
    x, y = (np.vstack([m, np.zeros((top - len(m), len(a)), np.uint32)]) for m in (x, y))
    swap = n > k
    x, y, n, k = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, k, n), np.where(swap, n, k)
    at = np.arange(top)[:, None]
    x[at >= n], y[at >= k] = 0x110000, 0x110001  # no letter; equal to nothing
    reach = np.maximum(k // 2 - 1, 0)
    near, far = (int(f(reach)) if len(a) else 0 for f in (np.min, np.max))
    mine, free = np.zeros(x.shape, bool), np.ones(y.shape, bool)
    for i in range(int(n.max(initial=0))):
        still = np.ones(len(a), bool)
        for j in range(max(0, i - far), min(top, i + far + 1)):
            met = (x[i] == y[j]) & free[j] & still
            if abs(i - j) > near:
                met &= reach >= abs(i - j)
            free[j] ^= met
            still ^= met
        mine[i] = ~still
    m = mine.sum(0)
    apart = np.bincount(np.repeat(np.arange(len(a)), m), x.T[mine.T] != y.T[~free.T], len(a)).astype(np.int64)
    some = np.maximum(m, 1)
    j = np.where(m > 0, (m / np.maximum(n, 1) + m / np.maximum(k, 1) + (m - apart // 2) / some) / 3, 0.0)
    prefix = np.logical_and.accumulate(x == y).sum(0)
    return np.where(j <= 0.7, j, j + np.minimum(0.1, 1 / np.maximum(k, 1)) * prefix * (1 - j))


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    a, b = a.to_numpy(), b.to_numpy()
    short, seen = [], {}
    for i, pair in enumerate(zip(a, b, strict=True)):
        if None in pair:
            continue
        if max(map(len, pair)) <= LETTERS:
            short.append(i)
            continue
        if pair not in seen:
            seen[pair] = jaro_winkler(*pair)
        out[i] = seen[pair]
    if short:
        out[short] = jaro_winkler_many(a[short].tolist(), b[short].tolist())
    return pd.Series(out)


def _cosine(a: Column, b: Column, q: int) -> Column:
    """Cosine of the q-gram counts."""
    x, y = qgrams(a, q), qgrams(b, q)

    def count(bag: Column, gram: Column) -> Column:
        return F.size(F.filter(bag, lambda g: g == gram))

    def square(bag: Column) -> Column:
        return F.aggregate(bag, F.lit(0).cast("bigint"), lambda s, g: s + count(bag, g))

    dot = F.aggregate(x, F.lit(0).cast("bigint"), lambda s, g: s + count(y, g))
    return F.try_divide(dot, F.sqrt(square(x)) * F.sqrt(square(y)))


def score(method: str, a: Column, b: Column) -> Column:
    """Similarity from 0 to 1; null or NaN where it is undefined (two values without q-grams)."""
    if method == "exact":
        return (a == b).cast("double")
    if method == "jaro_winkler":
        ship()
        return _jaro_winkler(a, b)
    name, _, size = method.partition("_")
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    q = SIZES[size]
    if name == "cosine":
        return _cosine(a, b, q)
    x, y = unique_qgrams(a, q), unique_qgrams(b, q)
    common = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y)
    return common / F.nullif(total - common, F.lit(0)) if name == "jaccard" else 2 * common / F.nullif(total, F.lit(0))


def similar(method: str, a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the score reaches the threshold; an undefined score does not."""
    if method == "exact":
        return F.coalesce(a == b, F.lit(False))
    s = score(method, a, b)
    return F.coalesce(~F.isnan(s) & (s >= threshold), F.lit(False))


def vector(fields: list[tuple[Column, Column]], method: str = "jaro_winkler", threshold: float = THRESHOLD) -> Column:
    """Which fields match, as an integer: bit j for field j."""
    out = F.lit(0)
    for j, (a, b) in enumerate(fields):
        out = out + F.when(similar(method, a, b, threshold), 1 << j).otherwise(0)
    return out


def linkage_score(vec: Column, m: list[float], u: list[float]) -> Column:
    """Sum over the fields of ln(m/u) where they match and ln((1-m)/(1-u)) where not."""
    out = F.lit(0.0)
    for j, (p, q) in enumerate(zip(m, u, strict=True)):
        out = out + F.when(vec.bitwiseAND(1 << j) > 0, math.log(p / q)).otherwise(math.log((1 - p) / (1 - q)))
    return out


def is_link(vec: Column, m: list[float], u: list[float], p: float) -> Column:
    """The odds of a match are at least one, given the share p of matches among all pairs."""
    return linkage_score(vec, m, u) + math.log(p / (1 - p)) >= 0
