"""Copies: the same results as row by row, and work that grows with different values, not with pairs of copies."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from privlink.operators import blocking, linkage
from privlink.plans.spec import EncodingSpec, blocking_groups

#: Ids that repeat (with one filter and with two), a null id, copies and a null filter.
SIDE_A = [(1, 3), (1, 3), (2, 3), (3, 3), (4, 9), (4, 12), (5, 12), (6, None), (None, 3), (7, 9)]
SIDE_B = [(1, 3), (2, 3), (2, 9), (8, 12), (8, 9), (9, 12), (9, 9), (None, 9), (10, 240), (4, 9)]
GROUPS = [[0, 1], [2, 3], [0, 3], [4, 5]]


def sides(spark):
    spec = EncodingSpec.make("CLK", ["n"], 1, 2, bits=8)
    return [
        spark.createDataFrame([(i, None if v is None else bytes([v])) for i, v in rows], "id int, enc binary").select("id", F.col("enc").alias("enc", metadata={"encoding": spec.to_json()}))
        for rows in (SIDE_A, SIDE_B)
    ]


def by_hand(least: int):
    """Hits of each pair of ids, and the matched rows of those with enough."""
    rows = lambda side: [(i, v) for i, v in side if i is not None and v is not None]
    key = lambda v, g: [v >> p & 1 for p in g]
    hits: dict = {}
    for (i, x), (j, y) in itertools.product(rows(SIDE_A), rows(SIDE_B)):
        same = sum(key(x, g) == key(y, g) for g in GROUPS)
        if same:
            hits[i, j] = hits.get((i, j), 0) + same
    often = {p: n for p, n in hits.items() if n >= least}
    matched = sorted((i, j) for (i, x), (j, y) in itertools.product(rows(SIDE_A), rows(SIDE_B)) if (i, j) in often and (x ^ y).bit_count() <= 2)
    return hits, often, matched


@pytest.mark.parametrize("strategy", blocking.STRATEGIES)
def test_classes_give_what_rows_give(spark, strategy):
    a, b = sides(spark)
    hits, often, matched = by_hand(4)
    got = blocking.metrics(a, b, GROUPS, 4, 2, F.col("aid") == F.col("bid"), strategy=strategy).first()
    assert (got.n_candidates, got.n_frequent, got.n_matched, got.n_true) == (len(hits), len(often), len(matched), sum(i == j for i, j in matched))
    assert sorted(map(tuple, blocking.block(a, b, GROUPS, 4, 2, strategy=strategy).collect())) == matched


@pytest.fixture(scope="module")
def hot(spark):
    """Two sides of 20,000 copies each, which share all keys but don't match: 400 million pairs."""
    spec = EncodingSpec.make("CLK", ["n"], 1, 2, bits=128)
    side = lambda last: spark.range(20_000).select("id", F.unhex(F.lit("00" * 15 + last)).alias("enc", metadata={"encoding": spec.to_json()}))
    return side("00"), side("ff"), blocking_groups(120, 10, 6, 1)


def test_metrics_of_copies(hot):
    start = time.time()
    got = blocking.metrics(*hot, 2, 3, F.col("aid") == F.col("bid")).first()
    assert (got.n_candidates, got.n_frequent, got.n_matched) == (4 * 10**8, 4 * 10**8, 0) and time.time() - start < 20


def classed(spark):
    (a, members_a), (b, members_b) = (blocking.classes(x, "enc") for x in sides(spark))
    return blocking.candidates(*(blocking.lsh_keys(x, GROUPS, "enc") for x in (a, b)), "shuffle"), members_a, members_b


def test_summary_of_classes(spark):
    a, b = sides(spark)
    _, often, matched = by_hand(4)
    got = blocking.blocked_summary(a, b, GROUPS, 4, 2).first()
    assert tuple(got) == (len(SIDE_A), len(SIDE_B), len(often), len(matched), len(SIDE_A) * len(SIDE_B))
    assert tuple(blocking.blocked_summary(a.limit(0), b, GROUPS, 4, 2).first()) == (0, len(SIDE_B), 0, 0, 0)


def test_frequent_pairs_of_members(spark):
    pairs, *members = classed(spark)
    assert {(r.aid, r.bid): r.hits for r in blocking.expand(blocking.frequent(pairs, 4), *members).collect()} == by_hand(4)[1]


def test_candidates_of_members(spark):
    pairs, *members = classed(spark)
    assert sorted(map(tuple, blocking.expand(pairs.distinct(), *members).collect())) == sorted(by_hand(1)[0])


def test_quality_of_counted_rows(spark):
    pairs, *members = classed(spark)
    sized = blocking.weigh(pairs.distinct(), *members).collect()
    same = {(r.aid, r.bid): r.n for r in blocking.same_ids(*members).collect()}
    hits = by_hand(1)[0]
    assert sum(r.n for r in sized) == len(hits) and sum(same.get((r.aid, r.bid), 0) for r in sized) == sum(i == j for i, j in hits)
    rows = spark.createDataFrame([(0.9, True, 3), (0.9, False, 2), (0.4, True, 1), (0.4, False, 0)], "s double, t boolean, n bigint")
    each = rows.select("s", "t", F.explode(F.expr("if(n > 0, sequence(1, n), array())")))
    args = F.col("s"), F.col("t"), [0.5, 0.8]
    counted = sorted(map(tuple, linkage.quality(rows, *args, F.col("n")).collect()))
    assert counted == sorted(map(tuple, linkage.quality(each, *args).collect())) and counted[0][1:5] == (3, 2, 0, 1)


#: Rows with repeated ids, null ids, null fields and copies.
PEOPLE = [(1, "ba", "x"), (2, "ba", "x"), (3, None, "x"), (4, "ab", None), (4, "ba", "x"), (5, "ab", None), (None, "ba", "x"), (6, "aabcbc", "y"), (7, "cabacb", "y"), (8, "aabcbc", "y"), (9, "cabacb", "y"), (0, "cabacb", "y")]


def before(fields, method, threshold):
    """In place of a similarity: another vector the other way round."""
    return sum((F.when(F.coalesce(a < b, F.lit(False)), 1 << j).otherwise(0) for j, (a, b) in enumerate(fields)), F.lit(0))


@pytest.mark.parametrize("other", [None, before])
def test_histogram_of_classes(spark, monkeypatch, other):
    if other:
        monkeypatch.setattr(linkage, "vector", other)
    df = spark.createDataFrame(PEOPLE, "id int, name string, kind string")
    want = linkage.vector_histogram(linkage.similarity_vectors(linkage.self_pairs(df, "id", ["name", "kind"]), ["name", "kind"]), 2)
    assert sorted(map(tuple, linkage.pair_histogram(df, "id", ["name", "kind"], blocks=2).collect())) == sorted(map(tuple, want.collect()))
    none = linkage.pair_histogram(df.limit(0), "id", ["name", "kind"], blocks=2)
    assert sorted(map(tuple, none.collect())) == [(v, 0) for v in range(4)]


def test_histogram_of_copies(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("name"), F.col("id") % 3).alias("name"))
    start = time.time()
    assert [r.n for r in linkage.pair_histogram(df, "id", ["name"], threshold=0.99, blocks=2).orderBy("vec").collect()] == [3 * 10**8, 3 * 10_000 * 9_999 // 2]
    assert time.time() - start < 20


def test_no_class_pair_in_vain(spark):
    """Different rows: each pair once, in the order of ids; fields may have the names of columns used inside."""
    df = spark.createDataFrame([(i, f"n{i}", i) for i in range(6)], "id int, size string, last int")
    pairs, members = linkage.class_pairs(df, "id", ["size", "last"], blocks=2)
    assert sorted((r.cls_a, r.cls_b) for r in pairs.collect()) == list(itertools.combinations(range(6), 2))
    assert linkage.pair_histogram(df, "id", ["size"], blocks=2).agg(F.sum("n")).first()[0] == 15


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_members_of_class_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(linkage, "CHUNK", chunk)
    df = spark.createDataFrame(PEOPLE, "id int, name string, kind string")
    fields = [f"{f}_{s}" for s in "ab" for f in ("name", "kind")]
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    want = text(linkage.self_pairs(df, "id", ["name", "kind"]).select("id_a", "id_b", *fields).collect())
    pairs, members = linkage.class_pairs(df, "id", ["name", "kind"], blocks=2)
    assert text(linkage.member_pairs(pairs.select("cls_a", "cls_b", *fields), members, "id").collect()) == want
    monkeypatch.setattr(linkage, "BROADCAST_ROWS", 0)
    assert text(linkage.member_pairs(pairs.select("cls_a", "cls_b", *fields), members, "id").collect()) == want
