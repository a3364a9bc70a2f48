"""Hamming LSH blocking of two encoded datasets, frequent pairs, and verification.

keys(A) join keys(B) -> count by pair >= collisions -> join A, B -> similarity.  One lazy plan: the partial aggregation
before the pair shuffle plays the combiner; adaptive execution splits hot keys of the key join.  ``strategy`` picks how B's
keys reach A's: "shuffle", "broadcast" (up to ``BROADCAST_ROWS`` keys), or "auto", which counts B first; "records" broadcasts
B's filters as well (up to ``BROADCAST_RECORDS``).  Beyond these ``block`` takes the next that holds any number (broadcast for
records, shuffle for both); a step that is called by itself refuses.

Where only matches are asked for, by Hamming distance, ``near`` turns the order round: keys carry the first ``WORDS`` words of
their filters, and a pair whose distance on these alone is beyond the threshold is gone where it is met, before pairs are
counted and dealt.  What is left is counted and verified as ever.

Ids with the same filters are one class (``classes``): keys, pairs, counts and comparisons are those of classes, one pass of ``expand``
lists the members' pairs at the end, and reports sum up sizes instead.  Copies cost rows of the result, not work on pairs.

Defined results: null filters have no keys and match nothing; repeated ids are entered one by one, so their pairs count their hits
together; null ids are in no pair; an empty side gives no pairs; other columns are not looked at.
"""

from __future__ import annotations

import csv
import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..plans.spec import EncodingSpec
from . import datasets, meeting

#: auto: B's keys are broadcast if few, and in ``block`` its filters as well; records: B's keys and its filters are, so that a pair is verified where it is found.
STRATEGIES = ("auto", "shuffle", "broadcast", "records")
#: Keys (rows of B times groups) that may be broadcast: about 24 bytes each.
BROADCAST_ROWS = 2_000_000
#: Records of B whose filters may be broadcast: some hundred bytes each.
BROADCAST_RECORDS = 200_000
#: Words up to which they are broadcast in each of B's keys (64 MB), not once for each record: a pair needs one look-up less.
BROADCAST_WORDS = 8 << 20
#: 64-bit words of a filter that go with its keys.
WORDS = 16


def lsh_keys(df: DataFrame, groups: list[list[int]], enc: str, id_col: str = "id") -> DataFrame:
    """(id_col, grp, key): the bits of each group, the first position lowest; a number up to 63 bits, else bytes in hex.

    A null filter has no keys; rows that repeat an id are entered one by one; an empty table gives an empty table.
    """
    return df.where(F.col(enc).isNotNull()).select(id_col, F.posexplode(_keys(groups)(F.col(enc))).alias("grp", "key"))


def _keys(groups: list[list[int]]):
    wide = len(groups[0]) > 63
    table = np.array(groups)

    @F.pandas_udf("array<string>" if wide else "array<bigint>")
    def keys(filters: pd.Series) -> pd.Series:
        raw = np.frombuffer(b"".join(filters), np.uint8).reshape(len(filters), -1)
        flat = np.unpackbits(raw, axis=1, bitorder="little")
        picked = flat[:, table]  # rows x groups x positions
        if wide:
            packed = np.packbits(picked, axis=2, bitorder="little")
            return pd.Series([[g.tobytes().hex() for g in row] for row in packed])
        weights = np.left_shift(np.int64(1), np.arange(table.shape[1], dtype=np.int64))
        return pd.Series(list(picked.astype(np.int64) @ weights))

    return keys


def _words(count: int):
    """The first words of a filter, with zeros behind its end."""

    @F.pandas_udf("array<bigint>")
    def words(filters: pd.Series) -> pd.Series:
        raw = np.frombuffer(b"".join(filters), np.uint8).reshape(len(filters), -1)[:, : 8 * count]
        full = np.zeros((len(filters), 8 * count), np.uint8)
        full[:, : raw.shape[1]] = raw
        return pd.Series(list(full.view("<i8")))

    return words


def classes(df: DataFrame, enc: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows (id_col, enc) of each class's least id, which names the class, and the members (id, cls) of all classes.

    Ids are in one class if their filters are the same, all of them where an id repeats; nulls on either side are in none.
    """
    heads, members = _classes(df, enc, id_col)
    return heads.drop("_rows"), members


def _classes(df: DataFrame, enc: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``classes`` with the number of rows of each class's least id as ``_rows``."""
    heads, members = datasets.classes(df.where(F.col(enc).isNotNull()), id_col, [enc])
    return heads.drop("_size", "_last"), members


def expand(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """Pairs (aid, bid, others) of classes as the pairs of their members."""
    a, b = members_a.toDF("_aid", "aid"), members_b.toDF("_bid", "bid")
    rest = [c for c in pairs.columns if c not in ("aid", "bid")]
    return pairs.join(a, "aid").join(b, "bid").select(F.col("_aid").alias("aid"), F.col("_bid").alias("bid"), *rest)


def weigh(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """Pairs (aid, bid, others) of classes and ``n``, how many pairs of members each stands for."""
    a, b = (m.groupBy(F.col("cls").alias(c)).agg(F.count("*").alias(n)) for m, c, n in ((members_a, "aid", "_na"), (members_b, "bid", "_nb")))
    return pairs.join(a, "aid").join(b, "bid").select(*pairs.columns, (F.col("_na") * F.col("_nb")).alias("n"))


def same_ids(members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """(aid, bid, n): of each pair of classes with ids in common, how many."""
    a, b = members_a.toDF("_id", "aid"), members_b.toDF("_id", "bid")
    return a.join(b, "_id").groupBy("aid", "bid").agg(F.count("*").alias("n"))


def check(a: EncodingSpec, b: EncodingSpec, groups: int, k: int, collisions: int) -> None:
    """Both sides are encoded alike; a pair can reach the collisions asked for."""
    if (a.scheme, a.bits, a.k, a.q, a.sizes, a.drawn, a.seeds, a.permutation_seed) != (b.scheme, b.bits, b.k, b.q, b.sizes, b.drawn, b.seeds, b.permutation_seed):
        raise ValueError("the two encodings differ")
    if not 1 <= k <= a.bits or not 1 <= collisions <= groups:
        raise ValueError("1 <= k <= bits and 1 <= collisions <= groups")


def candidates(keys_a: DataFrame, keys_b: DataFrame, strategy: str = "auto") -> DataFrame:
    """(aid, bid), once for each key that they share."""
    a, b, _ = _dealt(keys_a.toDF("aid", "grp", "key"), keys_b.toDF("bid", "grp", "key"), strategy)
    return a.join(b, ["grp", "key"]).select("aid", "bid")


def _dealt(a: DataFrame, b: DataFrame, strategy: str, count: int | None = None) -> tuple[DataFrame, DataFrame, int | None]:
    """Both sides' keys as the strategy wants them joined, and the number of B's if that is broadcast (``count``, if it is known)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {STRATEGIES}")
    if strategy != "shuffle":
        count = b.count() if count is None else count
        if strategy in ("broadcast", "records") and count > BROADCAST_ROWS:
            raise ValueError("too many keys to broadcast")
        if count <= BROADCAST_ROWS:
            # dealt by A's ids, so that pairs are counted where they are found; a given number of parts isn't made smaller at run time
            spark = a.sparkSession
            parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
            return a.repartition(parts, "aid"), F.broadcast(b), count
    return a, b, None


def near(a: DataFrame, b: DataFrame, groups: list[list[int]], threshold: float, size: int, enc_a: str, enc_b: str, strategy: str = "auto", id_a: str = "id", id_b: str = "id", records: int | None = None) -> DataFrame:
    """``candidates`` of the heads of ``_classes`` (B's are ``records``, if counted), without pairs whose first words alone are further
    apart than the threshold.

    An id of several rows has no words, as its rows count their hits together: its pairs all stay.  Where B's keys are broadcast its
    words are too, once for each record; beyond ``BROADCAST_RECORDS`` all pairs stay as well.
    """
    count = min(WORDS, -(-size // 64))
    held = lambda df, enc: F.when(F.col("_rows") == 1, _words(count)(F.col(enc)))
    sides = [df.select(i, F.posexplode(_keys(groups)(F.col(enc))), held(df, enc)) for df, enc, i in ((a, enc_a, id_a), (b, enc_b, id_b))]
    x, y = sides[0].toDF("aid", "grp", "key", "_a"), sides[1].toDF("bid", "grp", "key", "_b")
    if strategy == "shuffle":
        both = x.join(y, ["grp", "key"])
    else:
        full = y
        x, y, found = _dealt(x, y.drop("_b"), strategy, None if records is None else records * len(groups))
        if found is None:
            both = x.join(full, ["grp", "key"])
        elif found > BROADCAST_RECORDS * len(groups):
            return x.join(y, ["grp", "key"]).select("aid", "bid")
        elif found * count <= BROADCAST_WORDS:
            both = x.join(F.broadcast(full), ["grp", "key"])
        else:
            words = b.where("_rows = 1").select(F.col(id_b).alias("bid"), held(b, enc_b).alias("_b"))
            both = x.join(y, ["grp", "key"]).join(F.broadcast(words), "bid", "left")
    apart = sum((F.bit_count(F.get("_a", F.lit(i)).bitwiseXOR(F.get("_b", F.lit(i)))) for i in range(1, count)), F.bit_count(F.get("_a", F.lit(0)).bitwiseXOR(F.get("_b", F.lit(0)))))
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | (apart <= threshold)).select("aid", "bid")


def frequent(pairs: DataFrame, collisions: int) -> DataFrame:
    """(aid, bid, hits) of the pairs that share at least so many keys."""
    return pairs.groupBy("aid", "bid").agg(F.count("*").alias("hits")).where(F.col("hits") >= collisions)


def verify(pairs: DataFrame, a: DataFrame, b: DataFrame, enc_a: str, enc_b: str, method: str, threshold: float, id_a: str = "id", id_b: str = "id", records: bool = False, count: int | None = None) -> DataFrame:
    """(aid, bid) of the pairs whose filters match.  ``records``: B's filters are broadcast (their number, or ``count``, is checked)."""
    held = b.select(F.col(id_b).alias("bid"), F.col(enc_b).alias("_b"))
    if records:
        if (b.count() if count is None else count) > BROADCAST_RECORDS:
            raise ValueError("too many records to broadcast")
        held = F.broadcast(held)
    both = pairs.join(a.select(F.col(id_a).alias("aid"), F.col(enc_a).alias("_a")), "aid").join(held, "bid")
    return both.where(bits.similar(method, F.col("_a"), F.col("_b"), threshold)).select("aid", "bid")


def block(
    a: DataFrame,
    b: DataFrame,
    groups: list[list[int]],
    collisions: int,
    threshold: float,
    method: str = "hamming",
    strategy: str = "auto",
    id_a: str = "id",
    id_b: str = "id",
) -> DataFrame:
    """Matched (aid, bid) of two encoded datasets."""
    spec_a, spec_b = EncodingSpec.of(a.schema), EncodingSpec.of(b.schema)
    check(spec_a, spec_b, len(groups), len(groups[0]), collisions)
    enc_a, enc_b = _encoded(a), _encoded(b)
    (a, members_a), (b, members_b) = _classes(a, enc_a, id_a), _classes(b, enc_b, id_b)
    count = None if strategy == "shuffle" else b.count()  # a class's filters have a key for each group
    if strategy == "auto" and count <= BROADCAST_RECORDS and count * len(groups) <= BROADCAST_ROWS:
        strategy = "records"
    elif strategy in ("broadcast", "records") and count * len(groups) > BROADCAST_ROWS:
        strategy = "shuffle"
    elif strategy == "records" and count > BROADCAST_RECORDS:
        strategy = "broadcast"
    if method == "hamming":
        pairs = near(a, b, groups, threshold, spec_a.bits, enc_a, enc_b, strategy, id_a, id_b, count)
    else:
        pairs = candidates(lsh_keys(a, groups, enc_a, id_a), lsh_keys(b, groups, enc_b, id_b), strategy)
    return expand(verify(frequent(pairs, collisions), a, b, enc_a, enc_b, method, threshold, id_a, id_b, strategy == "records", count), members_a, members_b)


def _encoded(df: DataFrame) -> str:
    return next(f.name for f in df.schema if "encoding" in f.metadata)


#: Columns of a run's report.
METRICS = ("collisions", "n_groups", "k", "strategy", "n_candidates", "n_frequent", "n_matched", "n_true")


def metrics(a: DataFrame, b: DataFrame, groups: list[list[int]], collisions: int, threshold: float, truth: Column, method: str = "hamming", strategy: str = "shuffle") -> DataFrame:
    """One row (METRICS) on a blocking run: its parameters, the different pairs that share a key, those that share enough, those that
    match, and those matched that ``truth`` (of aid and bid) calls the same.  An empty side gives zeros."""
    enc_a, enc_b = _encoded(a), _encoded(b)
    fixed = {"collisions": F.lit(collisions), "n_groups": F.lit(len(groups)), "k": F.lit(len(groups[0])), "strategy": F.lit(strategy)}
    if strategy == "shuffle":
        met = meeting.met_totals(a, b, groups, collisions, threshold, method, enc_a, enc_b, True).withColumn("_same", truth)
        there = F.col("aid").isNotNull()
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_candidates", "n_frequent")]
        return met.agg(*sums, F.count_if(there).alias("n_matched"), F.count_if(there & F.col("_same")).alias("n_true")).withColumns(fixed).select(*METRICS)
    (a, members_a), (b, members_b) = classes(a, enc_a), classes(b, enc_b)
    hits = candidates(lsh_keys(a, groups, enc_a), lsh_keys(b, groups, enc_b), strategy).groupBy("aid", "bid").agg(F.count("*").alias("hits"))
    matched = expand(verify(hits.where(F.col("hits") >= collisions), a, b, enc_a, enc_b, method, threshold, records=strategy == "records"), members_a, members_b).withColumn("_same", truth)
    enough = F.when(F.col("hits") >= collisions, F.col("n"))
    one = weigh(hits, members_a, members_b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.coalesce(F.sum(enough), F.lit(0)).alias("n_frequent"))
    two = matched.agg(F.count("*").alias("n_matched"), F.count_if("_same").alias("n_true"))
    return one.join(two).withColumns(fixed).select(*METRICS)  # one row each


def timed_runs(runs: dict[str, tuple], out: str | None = None) -> list[dict]:
    """``metrics`` of each named run (its arguments as a tuple) with the seconds it took; written as CSV lines to ``out``."""
    rows = []
    for name, arguments in runs.items():
        start = time.time()
        row = metrics(*arguments).first().asDict()
        rows.append({"run": name, **row, "seconds": round(time.time() - start, 3)})
    if out and rows:
        with open(out, "w", newline="") as f:
            w = csv.DictWriter(f, list(rows[0]))
            w.writeheader()
            w.writerows(rows)
    return rows


def key_statistics(keys: DataFrame) -> DataFrame:
    """One row: groups, and the least, greatest and mean number of distinct keys of a group."""
    each = keys.groupBy("grp").agg(F.countDistinct("key").alias("n"))
    return each.agg(F.count("*").alias("n_groups"), F.min("n").alias("min_keys"), F.max("n").alias("max_keys"), F.avg("n").alias("avg_keys"))


def buckets(keys: DataFrame, id_col: str = "id") -> DataFrame:
    """(grp, key, ids): who shares a key.  A report; the join above never gathers a bucket."""
    return keys.groupBy("grp", "key").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def summary(a: DataFrame, b: DataFrame, freq: DataFrame, matched: DataFrame) -> DataFrame:
    """One row with the numbers of records, pairs, frequent pairs and matches."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(a, "n_a").join(one(b, "n_b")).join(one(freq, "n_frequent")).join(one(matched, "n_matched"))  # one row each
    return out.withColumn("n_pairs", F.col("n_a") * F.col("n_b"))


def blocked_summary(a: DataFrame, b: DataFrame, groups: list[list[int]], collisions: int, threshold: float, method: str = "hamming", strategy: str = "shuffle") -> DataFrame:
    """``summary`` of a run of ``block`` and its frequent pairs, from the sizes of classes: no pair of copies is made."""
    enc_a, enc_b = _encoded(a), _encoded(b)
    rows = lambda df, name: df.agg(F.count("*").alias(name))
    if strategy == "shuffle":
        met = meeting.met_totals(a, b, groups, collisions, threshold, method, enc_a, enc_b, False)
        sums = met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_frequent", "n_matched")])
        return rows(a, "n_a").join(rows(b, "n_b")).join(sums).withColumn("n_pairs", F.col("n_a") * F.col("n_b"))  # one row each
    (heads_a, members_a), (heads_b, members_b) = classes(a, enc_a), classes(b, enc_b)
    freq = frequent(candidates(lsh_keys(heads_a, groups, enc_a), lsh_keys(heads_b, groups, enc_b), strategy), collisions)
    matched = verify(freq, heads_a, heads_b, enc_a, enc_b, method, threshold, records=strategy == "records")
    pairs = lambda df, name: weigh(df, members_a, members_b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    out = rows(a, "n_a").join(rows(b, "n_b")).join(pairs(freq, "n_frequent")).join(pairs(matched, "n_matched"))  # one row each
    return out.withColumn("n_pairs", F.col("n_a") * F.col("n_b"))
