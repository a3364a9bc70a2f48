"""Pairs, similarity vectors, expectation maximisation, weights, and linkage quality.

Defined results: a null value agrees with nothing; rows that repeat an id pair with themselves under their own ids only as
often as the order of ids allows (a < b); fewer than two rows give no pairs; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import vector
from ..plans.spec import plan_sizes
from .datasets import classes, profile

#: Rows that may be broadcast as members of classes: some 16 bytes each.
BROADCAST_ROWS = 2_000_000
#: Members of a class on the left side that one task lists at a time.
CHUNK = 1024
ITERATIONS, TOLERANCE, TINY = 1000, 1e-5, 5e-324


def self_pairs(df: DataFrame, uid: str, fields: list[str], blocks: int = 1) -> DataFrame:
    """All pairs of rows with uid_a < uid_b, and their fields as {field}_a and {field}_b.

    ``blocks`` > 1 deals the rows into as many parts and joins part with part on an equi-key: each row is copied
    ``blocks`` times, tasks hold two parts at a time, and every pair is made once.  Exhaustive by definition: the number
    of pairs is quadratic, so at scale use blocking instead.
    """
    cols = [uid, *fields]
    if blocks <= 1:
        a, b = (df.select(*[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
        return a.join(b, F.col(f"{uid}_a") < F.col(f"{uid}_b"))
    part = F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int")
    dealt = df.select(*cols, part.alias("_p")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    a = dealt.select(*[F.col(c).alias(f"{c}_a") for c in cols], F.col("_p").alias("_i"), F.col("_o").alias("_j"))
    b = dealt.select(*[F.col(c).alias(f"{c}_b") for c in cols], F.col("_o").alias("_i"), F.col("_p").alias("_j"))
    return a.join(b, ["_i", "_j"]).where(F.col(f"{uid}_a") < F.col(f"{uid}_b")).drop("_i", "_j")


def class_pairs(df: DataFrame, uid: str, fields: list[str], blocks: int = 8) -> tuple[DataFrame, DataFrame]:
    """All pairs of classes of rows with the same fields of which some member of a comes before one of b, in both orders and each class
    with itself if so: cls_a, cls_b, _size_a, _size_b, and the fields as {field}_a and {field}_b; and the members (id, cls) of the classes.

    What depends on the fields alone is computed on these pairs; ``member_pairs`` lists those of ``self_pairs`` from them.  ``blocks``
    deals the classes as there, over blocks * blocks tasks.
    """
    if "cls" in fields:
        raise ValueError("no field may be named cls")
    heads, members = classes(df, uid, fields)
    part = F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int")
    dealt = heads.withColumn("_p", part).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cols = lambda s: [F.col(uid).alias(f"cls_{s}"), F.col("_size").alias(f"_size_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in fields]]
    a = dealt.select(*cols("a"), F.col("_p").alias("_i"), F.col("_o").alias("_j")).repartition(blocks * blocks, "_i", "_j")
    b = dealt.select(*cols("b"), "_last", F.col("_o").alias("_i"), F.col("_p").alias("_j")).repartition(blocks * blocks, "_i", "_j")
    return a.join(b, ["_i", "_j"]).where("cls_a < _last").drop("_i", "_j", "_last"), members


def member_pairs(pairs: DataFrame, members: DataFrame, uid: str) -> DataFrame:
    """Pairs (cls_a, cls_b, others) of classes as the pairs (uid_a, uid_b, others) of members with uid_a < uid_b.

    Members are broadcast if few.  A class of many members is listed in chunks, by several tasks.
    """
    spark = pairs.sparkSession
    rest = [c for c in pairs.columns if c not in ("cls_a", "cls_b")]
    hold = F.broadcast if members.count() <= BROADCAST_ROWS else lambda df: df
    from pyspark.sql import Window

    size = F.count("*").over(Window.partitionBy("cls"))
    left = members.withColumn("_k", F.pmod(F.xxhash64("id"), F.ceil(size / CHUNK))).select(F.col("cls").alias("cls_a"), "_k", F.col("id").alias(f"{uid}_a"))
    right = members.select(F.col("cls").alias("cls_b"), F.col("id").alias(f"{uid}_b"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = pairs.join(hold(left.select("cls_a", "_k").distinct()), "cls_a").repartition(tasks, "cls_a", "cls_b", "_k")
    both = chunks.join(hold(left), ["cls_a", "_k"]).join(hold(right), "cls_b")
    return both.where(F.col(f"{uid}_a") < F.col(f"{uid}_b")).select(f"{uid}_a", f"{uid}_b", *rest)


def cross_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b."""
    return a.crossJoin(b)


def pair_rank(i: Column, j: Column) -> Column:
    """Rank of the pair i < j among all pairs in order of j, then i."""
    i, j = i.cast("bigint"), j.cast("bigint")
    return F.shiftright(j * (j - 1), 1) + i


def rank_combination(members: list[int]) -> int:
    """Rank of an ascending k-combination: the sum of C(member, place)."""
    return sum(math.comb(c, i + 1) for i, c in enumerate(members))


def ranks_with(element: int, n: int) -> list[int]:
    """Ranks of all pairs of 0 .. n-1 that hold the element, ascending."""
    below = [math.comb(element, 2) + i for i in range(element)]
    return below + [math.comb(j, 2) + element for j in range(element + 1, n)]


def similarity_vectors(pairs: DataFrame, fields: list[str], method: str = "jaro_winkler", threshold: float = 0.7) -> DataFrame:
    """pairs with ``vec``, the integer of matching fields."""
    return pairs.withColumn("vec", vector([(F.col(f"{f}_a"), F.col(f"{f}_b")) for f in fields], method, threshold))


def vector_histogram(vectors: DataFrame, count: int) -> DataFrame:
    """(vec, n) for each of the 2^count vectors, also where there is none."""
    return _every_vector(vectors.groupBy("vec").agg(F.count("*").alias("n")), count)


def pair_histogram(df: DataFrame, uid: str, fields: list[str], method: str = "jaro_winkler", threshold: float = 0.7, blocks: int = 8) -> DataFrame:
    """``vector_histogram`` of the similarity vectors of all pairs of rows, from the sizes of classes: no pair of copies is made.

    Where a pair of classes has another vector the other way round, its members' pairs are listed, as their order tells which.
    """
    pairs, members = class_pairs(df, uid, fields, blocks)
    one, many = F.col("cls_a") == F.col("cls_b"), F.expr("cls_a <> cls_b and _size_a * _size_b > 1")
    back = [(F.when(many, F.col(f"{f}_b")), F.when(many, F.col(f"{f}_a"))) for f in fields]  # of two single rows the order is known
    scored = similarity_vectors(pairs.where("cls_a <= cls_b"), fields, method, threshold).withColumn("rev", vector(back, method, threshold))
    pairs_of = F.when(one, F.expr("_size_a * (_size_a - 1) div 2")).otherwise(F.col("_size_a") * F.col("_size_b"))
    open_ = many & (F.col("vec") != F.col("rev"))
    kinds = scored.groupBy("vec", F.when(open_, F.col("rev")).alias("rev"), F.when(open_, F.col("cls_a")).alias("cls_a"), F.when(open_, F.col("cls_b")).alias("cls_b"))
    kinds = kinds.agg(F.sum(pairs_of).alias("n"), F.count("*").alias("rows"))
    a, b = members.toDF("_a", "cls_a"), members.toDF("_b", "cls_b")  # one pass: kinds that stand for their pairs have no classes to list
    listed = kinds.join(a, "cls_a", "left").join(b, "cls_b", "left")
    vec = F.when(F.col("rev").isNull() | (F.col("_a") < F.col("_b")), F.col("vec")).otherwise(F.col("rev"))
    n = F.when(F.col("rev").isNull(), F.col("n")).otherwise(F.col("rows"))
    return _every_vector(listed.groupBy(vec.alias("vec")).agg(F.sum(n).alias("n")), len(fields))


def _every_vector(found: DataFrame, count: int) -> DataFrame:
    every = found.sparkSession.range(1 << count).select(F.col("id").cast("int").alias("vec"))
    return every.join(found, "vec", "left").select("vec", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@dataclass(frozen=True)
class Estimate:
    m: tuple[float, ...]
    u: tuple[float, ...]
    p: float
    iterations: int


def expectation_maximisation(histogram: list[int], m0: float = 0.9, u0: float = 0.001, p0: float = 0.1) -> Estimate:
    """Probabilities of agreement among matches (m) and others (u) and the share of matches (p), from 2^f frequencies.

    Without any pair the start values are the estimate, after no round; where all pairs are taken for matches (or none), the
    other class keeps its probabilities.
    """
    counts = np.asarray(histogram, float)
    fields = counts.size.bit_length() - 1
    if counts.size != 1 << fields or fields < 1:
        raise ValueError("2^f frequencies are needed")
    agrees = (np.arange(counts.size)[:, None] >> np.arange(fields)) & 1 == 1  # vectors by fields
    state = np.r_[np.full(fields, m0), np.full(fields, u0), p0]
    if not counts.sum():
        return _estimate(state, 0)
    for rounds in range(1, ITERATIONS + 1):
        likely = [np.where(agrees, chance, 1 - chance).prod(1) for chance in (state[:fields], state[fields:-1])]
        joint = np.array([state[-1] * likely[0], (1 - state[-1]) * likely[1]])
        share = np.divide(joint[0], joint.sum(0), out=np.zeros(counts.size), where=joint.sum(0) > 0)
        new = state.copy()
        for at, weight in ((0, share * counts), (fields, (1 - share) * counts)):
            if weight.sum() > 0:
                new[at : at + fields] = np.minimum(weight @ agrees / weight.sum(), 1.0)
        new[-1] = (share * counts).sum() / counts.sum()
        moved, state = np.abs(new - state).max(), new
        if moved <= TOLERANCE:
            break
    return _estimate(state, rounds)


def _estimate(state: np.ndarray, rounds: int) -> Estimate:
    fields = state.size // 2
    return Estimate(tuple(state[:fields].tolist()), tuple(state[fields:-1].tolist()), float(state[-1]), rounds)


def field_weights(m: list[float], u: list[float]) -> list[dict]:
    """Agreement and disagreement weight of each field, their distance, and its share of the sum of distances (equal shares
    where no field tells anything)."""
    log = lambda x: math.log(x if x > 0 else TINY)
    rows = [{"agree": log(a) - log(b), "disagree": log(1 - a) - log(1 - b)} for a, b in zip(m, u, strict=True)]
    total = sum(abs(r["agree"] - r["disagree"]) for r in rows)
    return [r | {"range": abs(r["agree"] - r["disagree"]), "share": abs(r["agree"] - r["disagree"]) / total if total else 1 / len(rows)} for r in rows]


def field_plan(df: DataFrame, uid: str, fields: list[str], bits: int, k: int, method: str = "jaro_winkler", threshold: float = 0.7, q: int = 2, blocks: int = 4) -> dict:
    """Averages of the fields, the estimate over all pairs, weights, and the filter sizes that follow from them, in one run.

    The result's "record_count", "fields" and "em" are what ``sources.files.save_statistics`` keeps; "sizes" is a row for each field.
    """
    averages = {r["field"]: r.asDict() for r in profile(df, fields).collect()}  # a row for each field
    counts = {r.vec: r.n for r in pair_histogram(df, uid, fields, method, threshold, blocks).collect()}  # 2^fields rows
    est = expectation_maximisation([counts[v] for v in range(1 << len(fields))])
    weights = field_weights(list(est.m), list(est.u))
    out: dict = {"record_count": next(iter(averages.values()))["n"], "fields": {}, "em": {"p": est.p, "iterations": float(est.iterations)}}
    for j, f in enumerate(fields):
        out["fields"][f] = {n: v for n, v in averages[f].items() if n.startswith("avg")} | {"m": est.m[j], "u": est.u[j], "share": weights[j]["share"]}
    grams = [averages[f][f"avg_{q}grams"] for f in fields]
    out["sizes"] = plan_sizes(fields, grams, [w["share"] for w in weights], bits, k)
    return out


def quality(pairs: DataFrame, score: Column, truth: Column, thresholds: list[float], count: Column | None = None) -> DataFrame:
    """For each threshold: true and false matches and non-matches, recall, precision, F1.  Rows without both are left out.

    ``count``: how many pairs a row stands for, else one.
    """
    each = pairs.select(score.alias("s"), truth.alias("t"), (F.lit(1) if count is None else count).alias("n"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    said = F.col("s") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy("threshold").agg(n(said & F.col("t")).alias("tm"), n(said & ~F.col("t")).alias("fm"), n(~said & ~F.col("t")).alias("tn"), n(~said & F.col("t")).alias("fn"))
    out = out.where("tm + fn > 0 and tm + fm > 0").withColumns({"recall": F.expr("tm / (tm + fn)"), "precision": F.expr("tm / (tm + fm)")})
    return out.withColumn("f1", F.expr("if(recall + precision = 0, 0D, 2 * recall * precision / (recall + precision))"))


def truth_by_digits(a: Column, b: Column) -> Column:
    """Ids such as a123 and b123_4 are the same entity when the digits after the letter agree."""
    number = lambda c: F.regexp_extract(c, r"\A[ab](\d+)(?:_\d+)?\z", 1)
    return (number(a) != "") & (number(a) == number(b))


def distance_statistics(pairs: DataFrame, distance: Column) -> DataFrame:
    return pairs.agg(F.min(distance).alias("min_d"), F.avg(distance).alias("mean_d"), F.max(distance).alias("max_d"), F.stddev_samp(distance).alias("std_d"))
