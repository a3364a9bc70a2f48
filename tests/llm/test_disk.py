"""What the operators leave on disk and deal out."""

import itertools
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from privlink.llm import common, minhash


@pytest.mark.parametrize("block", [2, 256])
def test_each_open_pair_meets_once(spark, monkeypatch, block):
    """Pairs of different components of a bucket meet in one block; members of its largest component don't meet."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(3)
    buckets = {(0, 7): [(i, 0) for i in range(20)] + [(20, 20)], (1, 7): [(i, 0) for i in range(9)], (2, 8): [(i, i) for i in range(7)], (2, 9): [(i, draw.choice([0, 1, 2])) for i in range(23)]}
    rows = [(band, key, i, c, 0) for (band, key), members in buckets.items() for i, c in members]
    dealt = minhash._deal(spark.createDataFrame(rows, "band int, key bigint, id bigint, component bigint, lead bigint")).collect()
    met: dict = {}
    blocks: dict = {}
    for r in dealt:
        assert r.part in (r.p, r.q)
        blocks.setdefault((r.band, r.key, r.p, r.q), []).append(r)
    for (band, key, p, q), members in blocks.items():
        for x, y in itertools.combinations(sorted(members, key=lambda r: r.id), 2):
            if {x.part, y.part} == {p, q} and x.component != y.component:
                met[band, key, x.id, y.id] = met.get((band, key, x.id, y.id), 0) + 1
    want = {(*b, i, j) for b, members in buckets.items() for (i, x), (j, y) in itertools.combinations(members, 2) if x != y}
    assert set(met) == want and set(met.values()) <= {1}
    assert sum(r.band == 0 for r in dealt) == (20 + 1 + 10 if block == 2 else 20 + 1 + 1)  # not each member for each part


def test_shuffle_files_go_with_the_cut(spark, tmp_path):
    folders = [f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {x for top in folders for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before = files()
    made = common.cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 100
    assert spark.conf.get(common.CLEANUP, "false") == "false"
