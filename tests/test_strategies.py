"""How often a blocking run counts B, and which side it broadcasts."""

import pytest
from privlink import queries
from privlink.operators import blocking
from privlink.plans.spec import blocking_groups

DATA = "/root/testdata/sf0.001"


def matched(spark, strategy):
    groups = blocking_groups(queries.BITS, queries.GROUP_BITS, queries.GROUPS, queries.SEED)
    sides = [queries._clk(spark, DATA, typo) for typo in (False, True)]
    return blocking.block(*sides, groups, queries.COLLISIONS, queries.DISTANCE, strategy=strategy)


def test_records_count_b_once(spark, monkeypatch):
    frame = type(spark.range(1))
    calls, count = [], frame.count
    monkeypatch.setattr(frame, "count", lambda self: calls.append(self.columns) or count(self))
    made = matched(spark, "records")
    assert len(calls) == 1
    monkeypatch.undo()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, matched(spark, "shuffle").collect()))


@pytest.mark.parametrize("limit, want", [(200_000, True), (3, False)])
def test_auto_broadcasts_few_filters(spark, monkeypatch, limit, want):
    given, verify = [], blocking.verify
    monkeypatch.setattr(blocking, "BROADCAST_RECORDS", limit)
    monkeypatch.setattr(blocking, "verify", lambda *a: given.append(a[9]) or verify(*a))
    made = matched(spark, "auto")
    assert given == [want]
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, matched(spark, "shuffle").collect()))


@pytest.mark.parametrize("strategy, limits", [("broadcast", {"BROADCAST_ROWS": 3}), ("records", {"BROADCAST_ROWS": 3}), ("records", {"BROADCAST_RECORDS": 3})])
def test_more_than_can_be_broadcast(spark, monkeypatch, strategy, limits):
    """A larger B is dealt otherwise, and nothing is refused."""
    want = sorted(map(tuple, matched(spark, "shuffle").collect()))
    for name, limit in limits.items():
        monkeypatch.setattr(blocking, name, limit)
    assert sorted(map(tuple, matched(spark, strategy).collect())) == want
