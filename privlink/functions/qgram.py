"""Q-grams as built-in expressions.  A value is padded with "_" and cut into all its runs of q characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def padded(c: Column) -> Column:
    """White-space runs become "_"; "_" is put in front and behind unless there already."""
    # each step refers to the one before it once: an expression that is named twice is computed twice
    front = F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), r"\A_", ""))
    return F.concat(F.regexp_replace(front, r"_\z", ""), F.lit("_"))


def _windows(padded_value: Column, q: int) -> Column:
    def cut(p):
        # sequence() counts down when the end is smaller, hence the guard
        some = F.transform(F.sequence(F.lit(1), F.length(p) - (q - 1)), lambda i: F.substring(p, i, F.lit(q)))
        return F.when(F.length(p) >= q, some).otherwise(F.array().cast(EMPTY))

    return F.get(F.transform(F.array(padded_value), cut), 0)  # the value is padded once, not for each window


def text(c: Column, compat: bool = False) -> Column:
    """The value as a string; with ``compat`` a null is the word "null", as a string conversion would give."""
    s = c.cast("string")
    return F.coalesce(s, F.lit("null")) if compat else s


def qgrams(c: Column, q: int, kind: str = "string", compat: bool = False) -> Column:
    """The bag of q-grams in order.  kind: string, number or boolean.  Null (unless compat) and empty give none."""
    if not 2 <= q <= 4:
        raise ValueError("q must be 2, 3 or 4")
    none = F.array().cast(EMPTY)
    if kind == "boolean":
        grams = {True: ["_T", "T_"], False: ["_F", "F_"]} if q == 2 else {True: ["_T_"], False: ["_F_"]}
        lists = {k: F.array(*map(F.lit, v)) for k, v in grams.items()}
        return F.when(c.isNull(), none).when(c.cast("boolean"), lists[True]).otherwise(lists[False])
    s = text(c, compat)
    if kind == "number":
        return F.when(s.isNull(), none).otherwise(_windows(F.concat(F.lit("_"), s, F.lit("_")), q))
    if kind != "string":
        raise ValueError(f"q-grams of {kind!r}")
    return F.when(s.isNull() | (s == ""), none).otherwise(_windows(padded(s), q))


def unique_qgrams(c: Column, q: int, kind: str = "string", compat: bool = False) -> Column:
    return F.array_distinct(qgrams(c, q, kind, compat))


def qgram_count(c: Column, q: int, kind: str = "string", compat: bool = False) -> Column:
    """How many q-grams there are, without making them."""
    if kind == "boolean":
        return F.when(c.isNull(), 0).otherwise(2 if q == 2 else 1)
    s = text(c, compat)
    p = padded(s) if kind == "string" else F.concat(F.lit("_"), s, F.lit("_"))
    count = F.greatest(F.length(p) - (q - 1), F.lit(0))
    return F.when(s.isNull(), 0).when((s == "") & F.lit(kind == "string"), 0).otherwise(count)


def unique_qgram_count(c: Column, q: int, kind: str = "string", compat: bool = False) -> Column:
    return F.size(unique_qgrams(c, q, kind, compat))


def kind_of(data_type: str) -> str:
    """string, number or boolean, from a Spark type name."""
    if data_type == "boolean":
        return "boolean"
    if data_type in ("int", "bigint", "float", "double", "smallint", "tinyint"):
        return "number"
    if data_type == "string":
        return "string"
    raise ValueError(f"type {data_type} has no q-grams")
