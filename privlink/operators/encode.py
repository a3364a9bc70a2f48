"""Records to bit vectors: one filter a record (CLK), a filter a field (FBF), or a sampled, permuted row filter (RBF).

A narrow map: each worker remembers, for each q-gram it has met, the bits that it sets in the result as one integer, so a
record costs a few look-ups and ORs whatever the number of hashes.  ``encode_native`` does the same by built-in
expressions and an aggregation, for comparison and for sessions without Python workers.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import positions, positions_of
from ..functions.qgram import kind_of, qgrams
from ..plans.spec import EncodingSpec
from ..runtime import ship

#: q-grams that a worker remembers for each field.
REMEMBER = 200_000


def _grams(df: DataFrame, spec: EncodingSpec, compat: bool) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.array_distinct(qgrams(df[f], spec.q, kind_of(kinds[f]), compat)) for f in spec.fields]


def encode(df: DataFrame, spec: EncodingSpec, key: bytes, include: list[str], compat: bool = False, name: str | None = None) -> DataFrame:
    """``include`` and the encoded column, which carries the spec in its metadata.  Null fields add nothing (with
    ``compat``: the q-grams of "null")."""
    ship(df.sparkSession)
    spec.check(df.schema)
    name = name or spec.column
    grams = _grams(df, spec, compat)
    picked = df.select(*include, *[g.alias(f"__g{j}") for j, g in enumerate(grams)])
    out = T.StructType([f for f in picked.schema if not f.name.startswith("__g")]).add(name, T.BinaryType(), False, {"encoding": spec.to_json()})
    size, count = math.ceil(spec.bits / 8), len(spec.fields)

    def run(batches):
        tables = [spec.targets(j) for j in range(count)]
        known: list[dict[str, int]] = [{} for _ in range(count)]

        def mask(j: int, gram: str) -> int:
            found = 0
            for p in positions_of(gram, spec.field_size(j), spec.k, key):
                for bit in tables[j][p]:
                    found |= 1 << bit
            if len(known[j]) >= REMEMBER:
                known[j].clear()
            known[j][gram] = found
            return found

        for batch in batches:
            columns = [batch.column(batch.num_columns - count + j).to_pylist() for j in range(count)]
            filters = []
            for row in zip(*columns, strict=True):
                bits = 0
                for j, found in enumerate(row):
                    have = known[j]
                    for g in found:
                        m = have.get(g)
                        bits |= mask(j, g) if m is None else m
                filters.append(bits.to_bytes(size, "little"))
            arrays = [batch.column(i) for i in range(batch.num_columns - count)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(filters, type=pa.binary())], names=[f.name for f in out])

    return picked.mapInArrow(run, out).select(*include, F.col(name).alias(name, metadata={"encoding": spec.to_json()}))


def encode_distinct(df: DataFrame, spec: EncodingSpec, key: bytes, include: list[str], compat: bool = False, name: str | None = None) -> DataFrame:
    """``encode`` where rows often have the same fields: each combination of values is encoded once and joined to its rows."""
    spec.check(df.schema)
    spark = df.sparkSession
    kinds = df.select(*spec.fields).distinct().repartition(2 * spark.sparkContext.defaultParallelism, *spec.fields)
    made = encode(kinds, spec, key, spec.fields, compat, "__enc").toDF(*[f"__f{j}" for j in range(len(spec.fields))], "__enc")
    same = functools.reduce(Column.__and__, [df[f].eqNullSafe(made[f"__f{j}"]) for j, f in enumerate(spec.fields)])
    return df.join(made, same).select(*[df[c] for c in include], made["__enc"].alias(name or spec.column, metadata={"encoding": spec.to_json()}))


def bit_positions(df: DataFrame, spec: EncodingSpec, key: bytes, include: list[str], compat: bool = False) -> DataFrame:
    """``include`` and the sorted set positions, by built-in expressions."""
    spec.check(df.schema)
    parts = []
    for j, grams in enumerate(_grams(df, spec, compat)):
        n = spec.field_size(j)
        found = F.flatten(F.transform(grams, functools.partial(_positions, n, spec.k, key)))
        if spec.scheme == "FBF":
            found = F.transform(found, functools.partial(_shift, sum(spec.sizes[:j])))
        elif spec.scheme == "RBF":
            table = F.array(*[F.array(*map(F.lit, t)).cast("array<int>") for t in spec.targets(j)])
            found = F.flatten(F.transform(found, functools.partial(_look, table)))
        parts.append(found)
    return df.select(*include, F.array_sort(F.array_distinct(F.concat(*parts))).alias("positions"))


def _positions(n: int, k: int, key: bytes, g: Column) -> Column:
    return positions(g, n, k, key)


def _shift(by: int, p: Column) -> Column:
    return p + by


def _look(table: Column, p: Column) -> Column:
    return F.get(table, p)
