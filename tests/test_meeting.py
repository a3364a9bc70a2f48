"""Pairs that share keys are counted and judged where they meet: the results of all rows against all, and no row of a pair is dealt out."""

import pytest
from pyspark.sql import functions as F
from test_copies import GROUPS, by_hand, sides

from privlink import queries
from privlink.operators import blocking, meeting

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["blocking_metrics", "blocking_summary", "fps_frequent", "lsh_candidates", "linkage_quality"])
def test_no_row_of_a_pair_is_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(blocking, "candidates", lambda *a: pytest.fail("a row for each key of a pair"))
    assert queries.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("small", [False, True])
def test_pairs_that_meet(spark, monkeypatch, small):
    """With repeated, null and copied ids; also with buckets, lists and runs of pairs cut as short as can be."""
    if small:
        for name in ("HOT", "CHUNK", "AT_ONCE", "FETCHED"):
            monkeypatch.setattr(meeting, name, 1)
    a, b = sides(spark)
    hits, often, matched = by_hand(4)
    assert sorted(map(tuple, meeting.met_pairs(a, b, GROUPS, 1).collect())) == sorted((*p, n) for p, n in hits.items())
    assert sorted(map(tuple, meeting.met_pairs(a, b, GROUPS, 4).collect())) == sorted((*p, n) for p, n in often.items())
    sums = [F.sum(c) for c in meeting.TOTALS]
    assert tuple(meeting.met_totals(a, b, GROUPS, 4, 2, "hamming", "enc", "enc", False).agg(*sums).first()) == (len(hits), len(often), len(matched))
    listed = meeting.met_totals(a, b, GROUPS, 4, 2, "hamming", "enc", "enc", True).where("aid is not null")
    assert sorted((r.aid, r.bid) for r in listed.collect()) == matched
    there = lambda df: [r for r in df.collect() if r.id is not None and r.enc is not None]
    want: dict = {}
    own: dict = {}
    for x in there(a):
        for y in there(b):
            if (x.id, y.id) in often:
                kind = ((x.enc[0] & y.enc[0]).bit_count(), (x.enc[0] | y.enc[0]).bit_count())
                want[kind] = want.get(kind, 0) + 1
                if x.id == y.id:
                    own[kind] = own.get(kind, 0) + 1
    assert {(r.both, r.either): r.n for r in meeting.met_scores(a, b, GROUPS, 4, 8).collect()} == want
    assert {(r.both, r.either): r.n for r in meeting.own_scores(a, b, GROUPS, 4).collect()} == own


@pytest.mark.parametrize("method, threshold", [("jaccard", 0.5), ("dice", 0.6)])
def test_other_methods(spark, method, threshold):
    a, b = sides(spark)
    args = (a, b, GROUPS, 2, threshold, F.col("aid") == F.col("bid"), method)
    shuffled, held = (tuple(blocking.metrics(*args, s).drop("strategy").first()) for s in ("shuffle", "records"))
    assert shuffled == held and shuffled[-2] > 0


def test_wide_keys_and_no_rows(spark):
    a, b = sides(spark)
    wide = [[0, 1, *[7] * 63], [2, 3, *[6] * 63]]
    narrow = [[0, 1, 7], [2, 3, 6]]
    rows = lambda groups, a=a: sorted(map(tuple, meeting.met_pairs(a, b, groups, 1).collect()))
    assert rows(wide) == rows(narrow) and len(rows(wide)) > 0
    assert rows(narrow, a.limit(0)) == []
    assert blocking.metrics(a.limit(0), b, narrow, 1, 2, F.lit(True)).first()[4:] == (0, 0, 0, 0)
