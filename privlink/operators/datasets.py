"""Profiles, unique ids, total order, sampling, column checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.qgram import kind_of, qgram_count, unique_qgram_count

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_fields(df: DataFrame, fields: list[str]) -> None:
    missing = [f for f in fields if f not in df.columns]
    if missing or not fields:
        raise ValueError(f"no such fields: {missing}")


def check_name(name: str) -> None:
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no dataset or field name")


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row a field: field, n, avg_length, and for q = 2, 3, 4 the mean number of q-grams and of distinct ones."""
    check_fields(df, fields)
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        kind = kind_of(kinds[f])
        aggs.append(F.avg(F.length(df[f].cast("string"))).alias(f"{i}_len"))
        for q in (2, 3, 4):
            aggs.append(F.avg(qgram_count(df[f], q, kind)).alias(f"{i}_q{q}"))
            aggs.append(F.avg(unique_qgram_count(df[f], q, kind)).alias(f"{i}_u{q}"))
    rows = [
        F.struct(F.lit(f).alias("field"), F.col("n"), F.col(f"{i}_len").alias("avg_length"), *[F.col(f"{i}_{k}{q}").alias(f"avg_{'unique_' * (k == 'u')}{q}grams") for q in (2, 3, 4) for k in "qu"])
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sort_rows(df: DataFrame, by: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """Total order: the sort fields first, then all others as tie-breakers; the sort fields come first in the schema."""
    check_fields(df, by)
    rest = [c for c in df.columns if c not in by]
    order = [F.desc(c) if c in descending else F.asc(c) for c in [*by, *rest]]
    return df.select(*by, *rest).orderBy(*order)


def with_uid(df: DataFrame, by: list[str], uid: str = "uid", start: int = 0) -> DataFrame:
    """A dense number in total order, as the first column.

    Range-partitioned and sorted once; within a partition rows are numbered by a running count, and each partition's
    offset is the count of those before it (one row a partition), so no task sees all rows.
    """
    check_fields(df, by)
    rest = [c for c in df.columns if c not in by]
    cols = [*by, *rest]
    placed = df.select(*cols).repartitionByRange(*cols).sortWithinPartitions(*cols)
    # monotonically_increasing_id is partition number << 33 plus the place within the partition
    numbered = placed.withColumn("_m", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    from pyspark.sql import Window

    counts = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = numbered.join(F.broadcast(offsets), "_p")
    return joined.select((F.col("_o") + F.col("_i") + start).alias(uid), *df.columns)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement (all, if there are fewer), the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns).limit(n)


def quick_sample(df: DataFrame, n: int, seed: int, fraction: float = 0.5) -> DataFrame:
    """One pass: each row with the given probability, the first n; may give fewer."""
    return df.sample(fraction, seed).limit(n)


def classes(df: DataFrame, id_col: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (id_col, cols, _size, _last, _rows) of each class's least id, which names the class, and the members (id, cls) of all classes.

    Ids with the same ``cols`` are one class of so many ids up to the last (all their rows, ``_rows`` an id, where one repeats); null ids are in none.
    """
    from pyspark.sql import Window

    there = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_r"))
    same = Window.partitionBy("_r")
    named = there.withColumns({"cls": F.min("id").over(same), "_size": F.count("*").over(same), "_last": F.max("id").over(same)})
    heads = named.where("id = cls").select("id", "_size", "_last", F.size("_r").alias("_rows"), F.explode("_r").alias("_r"))
    return heads.select(F.col("id").alias(id_col), *[F.col("_r")[c].alias(c) for c in cols], "_size", "_last", "_rows"), named.select("id", "cls")
