"""Connected components of a link table by alternating large and small stars, all in DataFrame operations.

Each round replaces a node's links by links to the smallest node in sight and ends when nothing changes; the number of
rounds grows with the logarithm of the largest component.  Minima are formed by partial aggregations.  The joins that hand them
back are not split by adaptive execution, as one side is an aggregate over its own shuffle: the links of one node (two numbers
each) meet in one task.  Each round is written to the shared folder.

Defined results: links of a node with itself and repeated links add nothing; without links there is no row; nulls are not
allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: More rounds than any input can need (2^64 nodes in a chain).
MOST_ROUNDS = 80


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS if mark[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        new_mark = _mark(new)
        edges = new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        if mark[0]:
            raise RuntimeError(f"links still change after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
