"""Bit vectors: bit i is bit i % 8 of byte i // 8.  Similarities of two columns, compared batch by batch on words.

Defined results: a null filter has null similarities and matches nothing; two empty filters have no similarity either; filters
of different sizes are refused; rows are answered one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

METHODS = ("jaccard", "hamming", "dice")


def from_positions(df: DataFrame, id_col: str, pos_col: str, n: int) -> DataFrame:
    """(id_col, filter): a filter of n bits (at most 32768) from an array of positions, JVM-side."""
    if n > 32768:
        raise ValueError("at most 32768 bits")
    made = df.select(id_col, F.explode(F.array_distinct(pos_col)).alias("p")).groupBy(id_col).agg(F.bitmap_construct_agg("p").alias("b"))
    size = math.ceil(n / 8)
    zero = F.unhex(F.lit("00" * size))
    cut = F.expr(f"substring(b, 1, {size})")
    return df.select(id_col).join(made, id_col, "left").select(id_col, F.coalesce(cut, zero).alias("filter"))


def false_positive_rate(m: int, k: int, n: int) -> float:
    """(1 - e^(-kn/m))^k for n entries of k hashes in m bits."""
    return (1 - math.exp(-(k * n) / m)) ** k


def _matrix(values: pd.Series) -> np.ndarray:
    size = max((len(v) for v in values), default=0)
    if any(len(v) != size for v in values):
        raise ValueError("filters of different sizes")
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), size)


def _counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ones = lambda v: np.bitwise_count(v).sum(1, dtype=np.int64)
    return ones(x & y), ones(x | y), ones(x ^ y), ones(x) + ones(y)


def _compared(a: pd.Series, b: pd.Series, value, kind: str) -> pd.Series:
    """``value`` of the counts where both filters are there, null elsewhere."""
    there = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([pd.NA] * len(a), dtype=kind)
    if there.any():
        out[there] = value(*_counts(_matrix(a[there]), _matrix(b[there])))
    return out


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom > 0)


@F.pandas_udf(T.LongType())
def _hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, lambda both, either, apart, total: apart, "Int64")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, lambda both, either, apart, total: both, "Int64")


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, lambda both, either, apart, total: _ratio(both, either), "Float64")


@F.pandas_udf(T.DoubleType())
def _dice(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, lambda both, either, apart, total: _ratio(2.0 * both, total), "Float64")


def hamming(a: Column, b: Column) -> Column:
    ship()
    return _hamming(a, b)


def common_ones(a: Column, b: Column) -> Column:
    ship()
    return _common(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Common over either; null for two empty filters."""
    ship()
    return _jaccard(a, b)


def dice(a: Column, b: Column) -> Column:
    """Twice the common over the sum; null for two empty filters."""
    ship()
    return _dice(a, b)


def similar(method: str, a: Column, b: Column, threshold: float) -> Column:
    """Whether two filters match: a distance of at most, or a similarity of at least, the threshold; two empty filters never do."""
    if method == "hamming":
        return F.coalesce(hamming(a, b) <= threshold, F.lit(False))
    if method in ("jaccard", "dice"):
        value = jaccard(a, b) if method == "jaccard" else dice(a, b)
        return F.coalesce(value >= threshold, F.lit(False))
    raise ValueError(f"{method!r} is none of {METHODS}")


def test_bit(c: Column, i: int) -> Column:
    """Whether bit i is set."""
    return F.conv(F.hex(c.substr(F.lit(i // 8 + 1), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(1 << i % 8)) != 0


def count_ones(c: Column, n: int) -> Column:
    """How many of the n bits are set."""
    return F.aggregate(words(c, n), F.lit(0), lambda s, x: s + F.bit_count(x))


def set_positions(c: Column, n: int, ones: bool = True) -> Column:
    """The positions of the bits that are set (or, without ``ones``, that are not), ascending."""

    def wanted(w: Column, i: Column) -> Column:
        set_ = F.getbit(F.get(w, F.shiftright(i, 6)), F.pmod(i, F.lit(64)))
        return set_ == F.lit(1 if ones else 0)

    every = F.sequence(F.lit(0), F.lit(n - 1))
    return F.get(F.transform(F.array(words(c, n)), lambda w: F.filter(every, lambda i: wanted(w, i))), 0)


def show_bits(c: Column) -> Column:
    """Hexadecimal digits, most significant byte first."""
    return F.reverse(F.regexp_replace(F.hex(c), "(.)(.)", "$2$1"))


def words(c: Column, n: int) -> Column:
    """The filter as an array of 64-bit words (for comparisons that have to stay JVM-side)."""
    size = 8 * math.ceil(n / 64)
    full = F.concat(c, F.unhex(F.lit("00" * (size - math.ceil(n / 8)))))
    return F.transform(F.sequence(F.lit(0), F.lit(size // 8 - 1)), lambda i: _word(full, i))


def _word(full: Column, i: Column) -> Column:
    eight = full.substr(i * 8 + 1, F.lit(8))
    byte = lambda j: F.conv(F.hex(eight.substr(F.lit(j + 1), F.lit(1))), 16, 10).cast("bigint")
    out = byte(0)
    for j in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(byte(j), 8 * j))
    return out


def hamming_words(a: Column, b: Column) -> Column:
    """Hamming distance of two word arrays, built in."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
