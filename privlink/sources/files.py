"""Datasets in and out: Parquet directories, typed CSV, bibliography XML, statistics and frequencies."""

from __future__ import annotations

import functools
import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "-NA-"
MISSING_XML = "-missing-"
# The record elements of the public bibliography format.
PUBLICATIONS = ("article", "inproceedings", "proceedings", "book", "incollection", "www", "phdthesis", "mastersthesis")


def read_dataset(spark: SparkSession, *paths: str, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    if limit is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def write_dataset(df: DataFrame, path: str, parts: int | None = None, mode: str = "errorifexists") -> None:
    (df.repartition(parts) if parts else df).write.mode(mode).parquet(path)


def _typed(c: Column, kind: str) -> Column:
    empty = c.isNull() | (c == "")
    if kind == "string":
        return F.when(empty, MISSING).otherwise(c)
    if kind in ("int", "bigint"):
        return F.when(empty, F.lit(0)).otherwise(F.trim(c).cast(kind)).cast(kind)
    if kind in ("float", "double"):
        return F.when(empty, F.lit(float("nan"))).otherwise(F.trim(c).cast(kind)).cast(kind)
    if kind == "boolean":
        return F.when(empty, F.lit(False)).otherwise(F.lower(F.trim(c)) == "true")
    raise ValueError(f"CSV field of type {kind}")


def parse_csv(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """Lines to typed columns: split at commas into at most as many parts as there are fields, so the last one keeps its
    commas; no quoting, no header.  Empty cells become "-NA-", 0, NaN or false."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parts = F.split(F.col(column), ",", len(schema))
    return lines.where(F.col(column) != "").select(*[_typed(F.get(parts, i), f.dataType.simpleString()).alias(f.name) for i, f in enumerate(schema)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return parse_csv(spark.read.text(path), schema)


def unescape(c: Column) -> Column:
    """Named Latin-1 entities (code points 192 to 255, from the standard table) to their characters."""
    for name, point in sorted(name2codepoint.items()):
        if 192 <= point <= 255:
            c = F.replace(c, F.lit(f"&{name};"), F.lit(chr(point)))
    return c


def read_bibliography(spark: SparkSession, path: str, tags: tuple[str, ...] = PUBLICATIONS) -> DataFrame:
    """(key, author, title, year): one row a record element; the first of each field; "-missing-" where there is none."""
    schema = "_key string, author array<string>, title array<string>, year array<string>"
    each = [spark.read.format("xml").option("rowTag", t).schema(schema).load(path) for t in tags]
    rows = functools.reduce(DataFrame.unionByName, each)
    first = lambda n: F.coalesce(unescape(F.get(F.col(n), 0)), F.lit(MISSING_XML)).alias(n)
    return rows.select(F.col("_key").alias("key"), first("author"), first("title"), first("year"))


def import_bibliography(spark: SparkSession, path: str, out: str, parts: int | None = None) -> None:
    """Bibliography XML to Parquet; with ``parts`` in key order over so many files."""
    df = read_bibliography(spark, path)
    if parts:
        df = df.repartitionByRange(parts, "key").sortWithinPartitions("key")
    df.write.parquet(out)


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text, through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def save_statistics(spark: SparkSession, path: str, stats: dict) -> None:
    _put_text(spark, path, stats_to_properties(stats))


def load_statistics(spark: SparkSession, path: str) -> dict:
    return stats_from_properties(_get_text(spark, path))


def save_schema(df: DataFrame, path: str) -> None:
    """The schema with its metadata (the encoding among it), as JSON."""
    _put_text(df.sparkSession, path, df.schema.json())


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(_get_text(spark, path)))


def describe(df: DataFrame) -> DataFrame:
    """A row for each column: position, name, type, nullable, and its encoding (else null)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("encoding")) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean, encoding string")


def stats_to_properties(stats: dict) -> str:
    """Statistics as key=value lines: record.count, field.names, f.{field}.{measure}, em.*."""
    lines = [f"record.count={stats['record_count']}", "field.names=" + ",".join(stats["fields"])]
    for field, values in stats["fields"].items():
        lines += [f"f.{field}.{k}={v!r}" for k, v in sorted(values.items())]
    lines += [f"em.{k}={v!r}" for k, v in sorted(stats.get("em", {}).items())]
    return "\n".join(lines) + "\n"


def stats_from_properties(text: str) -> dict:
    pairs = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    out: dict = {"record_count": int(pairs["record.count"]), "fields": {f: {} for f in pairs["field.names"].split(",")}, "em": {}}
    for k, v in pairs.items():
        if k.startswith("f."):
            field, _, measure = k[2:].partition(".")
            out["fields"][field][measure] = float(v)
        elif k.startswith("em."):
            out["em"][k[3:]] = float(v)
    return out


def frequencies_to_json(histogram: list[int], fields: list[str]) -> str:
    return json.dumps({"field.count": len(fields), "fields": fields, "vec": histogram})


def frequencies_from_json(text: str) -> tuple[list[int], list[str]]:
    got = json.loads(text)
    return got["vec"], got["fields"]


def report_pairs(pairs: list[tuple[str, str]]) -> str:
    """All pairs up to 100, else the first 26 and the last 25."""
    shown = [f"{a} {b}" for a, b in pairs]
    if len(shown) > 100:
        shown = [*shown[:26], "...", *shown[-25:]]
    return "\n".join(shown)
